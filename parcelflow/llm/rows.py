"""What the operators share: keys of rows, and columns kept out of the way of the caller's."""

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text) -> Column:
    """128 bits of a text as two independent longs; equal for equal texts only."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def core(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: clashing names in other columns can do no harm."""
    return df.select(*[df[name].alias(alias) for alias, name in columns.items()])


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


_CACHES: dict[str, dict] = {}


def own_cache(name: str, cache: dict) -> None:
    """Empty what other operators remember in this Python worker, which Spark uses again for one operator after another."""
    others = set(_CACHES) - {name}
    for other in others:
        _CACHES.pop(other).clear()
    _CACHES[name] = cache
    if others:
        give_back()


def give_back() -> None:
    """Hand memory that is free again back to the system: what a worker's allocators keep counts as the executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def map_slices(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, arrow: pa.Schema, rows: int = 512) -> DataFrame:
    """``fn`` over at most ``rows`` rows at a time: whole Arrow batches of texts as Python objects would take much memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield pa.RecordBatch.from_pandas(fn(batch.slice(i, rows).to_pandas()), schema=arrow, preserve_index=False)
    return df.mapInArrow(run, schema)


#: Bits of the map in ``likely_in``: 32 or more for each wanted key, but 128 KB at least and 16 MB at most.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27


def _in_map(rows: DataFrame, key: str, wanted: DataFrame) -> Column:
    """Whether the bit of ``key`` is set in a map of the wanted keys."""
    n = wanted.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * n).bit_length()))
    place = F.pmod(F.col(key), F.lit(size))
    word, bit = F.shiftright(place, 6).cast("int"), F.expr(f"shiftleft(1L, CAST(pmod(`{key}`, 64) AS INT))")
    zeros = rows.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = zeros.unionByName(wanted.select(word.alias("word"), bit.alias("bit"))).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("bitmap"))
    return F.get(bitmap.scalar(), word).bitwiseAND(bit) != 0


def likely_in(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key``, a long hash, is in the column of the same name of ``wanted``, and few others; to be joined afterwards.

    A bitmap of the wanted keys goes to the tasks, so most other rows need no shuffle. With far more keys than bits it lets more rows pass.
    ``wanted`` is counted and read: pass a written table.
    """
    return rows.where(_in_map(rows, key, wanted))


def split_likely(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``likely_in``, and all other rows, none of which is wanted: they need no join."""
    found = _in_map(rows, key, wanted)
    return rows.where(found), rows.where(~found)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(left: DataFrame, right: DataFrame, keys: tuple, how: str = "left") -> DataFrame:
    """Null-safe join that keeps the left side's keys once."""
    return left.join(right, same(left, right, *keys), how).select(
        *[left[c] for c in left.columns], *[right[c] for c in right.columns if c not in keys])
