"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

A row's hash is 62 bits: 40 of its id and text, then 22 that tell equal rows apart. A bucket is the rows that share the first ``depth``
bits. A bucket over the byte limit splits on the next bit, until every bucket fits or holds one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rows import core

BITS, OWN_BITS = 62, 40


def prefix(hashed: Column, depth: int) -> Column:
    """The first ``depth`` of the 62 bits."""
    return F.shiftright(hashed, BITS - depth)


def _bits() -> Column:
    own = F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 64 - OWN_BITS)
    tie = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - (BITS - OWN_BITS))
    return F.shiftleft(own, BITS - OWN_BITS).bitwiseOR(tie)


def hashed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits, n_bytes), written to the shared folder, since the last bits hold only as long as the rows stay where they are."""
    rows = core(docs, doc_id=id_col, text=text_col)
    return materialize(rows.select("doc_id", _bits().alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "hashed")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows) of ``hashed_rows``: the buckets at which splitting ends.

    The rows are counted by a prefix that is a few bits longer than an even spread needs, and shorter prefixes are summed from these
    counts. Only buckets still oversized at that length are counted again, eight bits deeper.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0]
    if total is None:
        return rows.sparkSession.createDataFrame([], "shard long, depth int, shard_bytes long, shard_rows long")
    top, leaves = 0, None
    bottom = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    inside = rows
    while True:
        cells = materialize(inside.groupBy(prefix(F.col("bits"), bottom).alias("cell")).agg(
            F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows")), "cells")
        levels = F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth")
        buckets = cells.select("*", levels).groupBy(F.expr(f"shiftright(cell, {bottom} - depth)").alias("shard"), "depth").agg(
            F.sum("shard_bytes").alias("shard_bytes"), F.sum("shard_rows").alias("shard_rows"))
        buckets = materialize(buckets.withColumn("over", (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)), "buckets")
        # a bucket is in the directory if it fits and the one that it was split from doesn't
        split = buckets.where("over").select(F.col("shard").alias("from_shard"), F.col("depth").alias("from_depth"))
        fits = buckets.where("NOT over")
        parent = fits.withColumn("_parent", F.shiftright("shard", 1)).withColumn("_above", F.col("depth") - 1)
        found = parent.join(split, (parent["_parent"] == split["from_shard"]) & (parent["_above"] == split["from_depth"]), "left_semi")
        if top == 0:
            found = found.unionByName(parent.where("depth = 0"))
        found = found.select("shard", "depth", "shard_bytes", "shard_rows")
        if bottom == BITS:
            found = found.unionByName(buckets.where(f"over AND depth = {BITS}").select("shard", "depth", "shard_bytes", "shard_rows"))
        leaves = found if leaves is None else leaves.unionByName(found)
        deepest = materialize(buckets.where(F.col("over") & (F.col("depth") == bottom)).select("shard"), "over")
        if bottom == BITS or deepest.isEmpty():
            return materialize(leaves, "directory")
        at = prefix(F.col("bits"), bottom)
        inside = materialize(inside.join(deepest, at == deepest["shard"], "left_semi"), "inside")
        top, bottom = bottom, min(BITS, bottom + 8)


def located(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the directory entry of their bits: looked up by their prefix of each length that the directory has."""
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # at most 63
    tries = F.array(*[F.struct(prefix(F.col("bits"), d).alias("shard"), F.lit(d).alias("depth")) for d in depths or [0]])
    tried = rows.select("*", F.explode(tries).alias("_try")).select(*rows.columns, "_try.shard", "_try.depth")
    return tried.join(leaves.select("shard", "depth", "shard_bytes"), ["shard", "depth"])


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes): the shard of each row; no shard holds over ``limit`` bytes unless it is one row.

    ``shard`` is the first ``depth`` bits as a number; both together name it. Nulls and empty texts hold 0 bytes, a null id is hashed as
    such, repeated rows are told apart by their place, other columns are left out, an empty table gives no rows.
    """
    rows = hashed_rows(docs, id_col, text_col)
    leaves = directory(rows, limit)
    return located(rows, leaves).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows' ids and texts as Parquet in a folder per shard (``depth=../shard=..``); returns the directory.

    An oversized bucket has been split before, so no write task gets more than the byte limit or one row.
    """
    whole = materialize(core(docs, doc_id=id_col, text=text_col), "rows")
    rows = whole.withColumn("bits", _bits()).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = materialize(rows, "hashed")
    leaves = directory(rows.select("bits", "n_bytes"), limit)
    located(rows, leaves).select("doc_id", "text", "depth", "shard").repartition("depth", "shard").write.partitionBy("depth", "shard").parquet(path)
    return leaves
