"""Removal of cross-site boilerplate lines by the number of distinct sites that a line is on.

A HyperLogLog sketch of the sites for each line's hash, merged by the aggregation, estimates that number. Lines whose estimate is too
close to the threshold to tell get an exact distinct count. A line on enough sites is kept once in the corpus, in the document with the
smallest id, and removed elsewhere. Where such lines are the larger part of a document it may be no page with boilerplate but a copy of
another document. A join decides: what is a copy stays whole for near-duplicate detection, which keeps one of each group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from . import minhash
from .rows import attach, core, likely_in, same, split_likely, text_key

#: What a line's ends may have without being another line.
BLANK = " \t\r\x0b\x0c"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _line_rows(keyed: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, site, at, line hash, n_words) of each line with at least ``min_words`` words."""
    lines = keyed.select("doc_id", "key", "site", F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).where("line != ''")
    n_words = F.size(F.split("line", r"[ \t\r\x0B\f]+"))
    return lines.select("doc_id", "key", "site", "at", text_key(F.col("line")).alias("line"), n_words.alias("n_words")).where(F.col("n_words") >= min_words)


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int = 10) -> DataFrame:
    """(line) of the lines that are on at least ``min_sites`` distinct sites; ``lines`` has ``line`` and ``site``. A null site is a site."""
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit(""))
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg(site, F.lit(lg_k)).alias("sketch"))
    estimate = F.hll_sketch_estimate("sketch")
    error = 4 * 1.04 / math.sqrt(2 ** lg_k)  # four standard errors
    guessed = materialize(sketched.select("line", estimate.alias("sites")).where(F.col("sites") >= math.floor(min_sites * (1 - error))), "spread")
    sure = guessed.where(F.col("sites") > math.ceil(min_sites * (1 + error))).select("line")
    near = guessed.where(F.col("sites") <= math.ceil(min_sites * (1 + error))).select("line")
    counted = lines.select("line", site.alias("site")).join(near, "line", "left_semi").distinct().groupBy("line").count()
    return materialize(sure.unionByName(counted.where(F.col("count") >= min_sites).select("line")), "boilerplate")


def _copies(keyed: DataFrame, by_doc: DataFrame, min_words: int, max_share: float, copy_words: int, copy_percent: int) -> DataFrame:
    """(doc_id, key, whole) of the documents that would lose over ``max_share`` of their words and are copies of another one.

    Either another document is alike in its ``copy_words``-word shingles by ``copy_percent`` or more, and keeps its lines too, or all
    lines of the document that count stand in one and the same other document.
    """
    held = likely_in(keyed.withColumn("a", F.col("key.a")), "a", by_doc.select(F.col("key.a").alias("a"))).select("doc_id", "key", "text")
    held = attach(held, by_doc.toDF(*by_doc.columns), ("doc_id", "key"), "inner")  # under new names, as the bitmap is made of it too
    n_words = F.size(F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANK + "\n")), r"[ \t\r\n\x0B\f]+"))
    counting = F.filter(F.transform(split_lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANK))),
                        lambda x: (x != "") & (F.size(F.split(x, r"[ \t\r\x0B\f]+")) >= min_words))
    held = held.withColumn("most", F.col("gone_words") > n_words * F.lit(max_share)).where(F.col("most") | (F.size("gone") == 0))
    inside = F.col("most") & F.col("low").eqNullSafe(F.col("high")) & (F.size(counting) == F.size("gone"))
    held = materialize(held.select("doc_id", "key", "text", "most", inside.alias("inside")), "line-copies")

    # only documents that lose no line, or may stay whole, can be what near-duplicate detection sees a copy of
    alike = minhash.near_duplicates(held, size=copy_words, percent=copy_percent).where("n_shingles > 0")
    alike = materialize(alike.select("component", "doc_id", F.col("key").alias("a")).distinct(), "line-alike")
    several = alike.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    alike = alike.join(several, "component").select("doc_id", "a")
    most = held.where("most").select("doc_id", "key", "inside", F.col("key.a").alias("a")).distinct()
    near = most.join(alike, same(most, alike, "doc_id", "a"), "left_semi").select("doc_id", "key")
    return materialize(near.unionByName(most.where("inside").select("doc_id", "key")).distinct().withColumn("whole", F.lit(True)), "line-whole")


def dedup_lines(docs: DataFrame, min_sites: int = 3, min_words: int = 3, max_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                site_col: str = "source", copy_words: int = 5, copy_percent: int = 80) -> DataFrame:
    """(doc_id, key, text, n_lines, n_removed, n_left, site): every row, ``key`` the hash of its whole text, ``text`` the rest without lines that are boilerplate across sites.

    ``n_left`` counts such lines that stay since they make up more than ``max_share`` of the words of a document that is a copy of another
    one: one alike by ``copy_percent`` of the ``copy_words``-word shingles, or one that holds all its lines. Lines of fewer than
    ``min_words`` words tell nothing and stay. A null text has no line and stays null; an empty text has one empty line, which stays;
    repeated rows, and rows of one id with equal texts, are treated alike; a null id counts as the largest; other columns are left out.
    """
    keyed = core(docs, doc_id=id_col, text=text_col, site=site_col).withColumn("site", F.col("site").cast("string"))
    keyed = keyed.withColumn("key", text_key(F.col("text")))
    lines = materialize(_line_rows(keyed, min_words), "lines")  # read three times below; texts are cut and hashed once
    common = spread_lines(lines, min_sites)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key.a", "key.b", "at")
    hits = materialize(lines.join(common, "line", "left_semi").select("line", "doc_id", "key", "at", "n_words").distinct(), "line-hits")
    release(lines)
    first = materialize(hits.groupBy("line").agg(F.min(order).alias("first")), "first-lines")
    kept = hits.select("*", order.alias("place")).join(first, "line").withColumn("goes", ~F.col("place").eqNullSafe(F.col("first")))
    goes, origin = F.col("goes"), F.struct("first.last", "first.doc_id", "first.a", "first.b")
    by_doc = materialize(kept.groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set(F.when(goes, F.col("at")))).alias("gone"), F.sum(F.when(goes, F.col("n_words")).otherwise(0)).alias("gone_words"),
        F.min(F.when(goes, origin)).alias("low"), F.max(F.when(goes, origin)).alias("high")), "line-gone")
    copies = _copies(keyed, by_doc, min_words, max_share, copy_words, copy_percent)

    by_doc = materialize(attach(by_doc.where(F.size("gone") > 0).select("doc_id", "key", "gone"), copies, ("doc_id", "key")).withColumn("a", F.col("key.a")), "line-texts")
    release(hits, first, copies)
    maybe, others = split_likely(keyed.withColumn("a", F.col("key.a")), "a", by_doc)  # only texts that may change are joined
    none = by_doc.schema
    whole = attach(maybe.drop("a"), by_doc.drop("a").toDF(*by_doc.columns[:-1]), ("doc_id", "key")).unionByName(others.drop("a").withColumns(
        {c: F.lit(None).cast(none[c].dataType) for c in ("gone", "whole")}))
    lines_of = whole.select("doc_id", "key", "site", "text", "gone", "whole", split_lines(F.col("text")).alias("lines"))
    strip = F.col("gone").isNotNull() & F.col("whole").isNull()
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rest = F.array_join(F.transform(places, lambda i: F.get("lines", i)), "\n")
    count = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone"))
    return lines_of.select("doc_id", "key", F.when(strip, rest).otherwise(F.col("text")).alias("text"),
                           F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("lines")).alias("n_lines"),
                           F.when(strip, count).otherwise(F.lit(0)).alias("n_removed"), F.when(strip, F.lit(0)).otherwise(count).alias("n_left"), "site")
