"""Order-dependent operators, for groups of any size, orders of any type and keys with NULLs.

A group that one task can order is a plain window. Larger groups are dealt by sampled bounds on key and order to range partitions of about
equal size; the window works inside a group's part of a partition, each part leaves one carry, and the carries, added up in order, are joined
back. Keys compare as in a grouping: NULL equals NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.operators.joins import join_same
from parcelflow.session import materialize

#: Rows of a group that one task puts in order.
CHUNK = 1_000_000
PART = "__part"


def rank_groups(df: DataFrame, keys: list[str], order, out: str = "rank") -> DataFrame:
    """Rank with ties. Use after an aggregate, when a group is small."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*keys).orderBy(order)))


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by an explicit order, as a map-side combined minimum (no per-key sort)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def first_two(df: DataFrame, keys: list[str], value: str, first: str, second: str) -> DataFrame:
    """Smallest and second smallest value per group (equal values count separately).

    Equal values are counted first; then the minimum, its count and the next distinct value decide.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    low = counts.groupBy(*keys).agg(F.min(F.struct(F.col(value).alias("v"), F.col("__n").alias("n"))).alias("__m"))
    above = (counts.join(low, keys).where(F.col(value) > F.col("__m.v"))
             .groupBy(*keys).agg(F.min(value).alias("__next")))
    return low.join(above, keys, "left").select(
        *keys, F.col("__m.v").alias(first), F.when(F.col("__m.n") > 1, F.col("__m.v")).otherwise(F.col("__next")).alias(second))


def group_stats(df: DataFrame, keys: list[str], stats: dict) -> DataFrame:
    """Rows with statistics of their group, through a written aggregate and a join instead of a window.

    With few groups the join is a broadcast, and the rows of a hot group are not shuffled at all.
    """
    return join_same(df, materialize(df.groupBy(*keys).agg(*[e.alias(n) for n, e in stats.items()]), "group-stats"), keys)


def in_parts(df: DataFrame, keys: list[str], order: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """The rows with ``__part``, and those of them whose group has several parts, or None if there are none.

    Parts of a group follow one another in the given order. Groups of more than ``chunk`` rows are range partitioned; the sort needs no value
    to be of any type or scale, and equal orders stay in one part. All others are part 0 and not moved. There are no more parts than a shuffle
    has tasks as long as these have at most ``CHUNK`` rows: far smaller parts, each a task and a file, cost more than what is in them.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > chunk)
    n = sizes.agg(F.sum("__n")).first()[0]  # one number
    if n is None:
        return df.withColumn(PART, F.lit(0)), None
    sizes = materialize(sizes, "large-groups")
    if keys:
        large, rest = join_same(df, sizes.select(*keys), keys, "left_semi"), join_same(df, sizes.select(*keys), keys, "left_anti")
    else:
        large, rest = df, None
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(-(-int(n) // chunk), max(tasks, -(-int(n) // CHUNK)))
    ranged = large.repartitionByRange(parts, *keys, order)
    large = materialize(ranged.withColumn(PART, F.spark_partition_id()), "ranges")
    return (large if rest is None else large.unionByName(rest.withColumn(PART, F.lit(0)))), large


def part_window(keys: list[str], order: str):
    return Window.partitionBy(*keys, PART).orderBy(order)


def carry(large: DataFrame, keys: list[str], tails: dict[str, Column], heads: Callable) -> DataFrame:
    """(keys, part, what the earlier parts leave), small: one row per part of a large group. ``heads`` maps a window over the parts to columns."""
    left = large.groupBy(*keys, PART).agg(*[c.alias(n) for n, c in tails.items()])
    return materialize(left.select(*keys, PART, *[c.alias(n) for n, c in heads(Window.partitionBy(*keys).orderBy(PART)).items()]), "carries")


def _upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def _before(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def with_previous(df: DataFrame, keys: list[str], order: str, cols: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """Previous row's values along an order."""
    rows, large = in_parts(df, keys, order, chunk)
    inside = part_window(keys, order)
    out = rows.withColumns({n: F.lag(c).over(inside) for n, c in cols.items()})
    if large is None:
        return out.drop(PART)
    last = F.max_by(F.struct(*[F.col(c).alias(n) for n, c in cols.items()]), F.struct(order))
    heads = carry(large, keys, {"__tail": last}, lambda parts: {"__prev": F.lag("__tail").over(parts)})
    out = join_same(out.withColumn("__first", F.row_number().over(inside) == 1), heads, [*keys, PART], "left")
    return out.withColumns({n: F.when(F.col("__first"), F.col(f"__prev.{n}")).otherwise(F.col(n)) for n in cols}).drop(PART, "__first", "__prev")


def consecutive_pairs(df: DataFrame, keys: list[str], order: str, node: str, a: str = "A", b: str = "B",
                      chunk: int = CHUNK) -> DataFrame:
    """(previous node, node) along each group."""
    out = with_previous(df.withColumn("__row", F.lit(True)), keys, order, {"__prev_node": node, "__prev_row": "__row"}, chunk)
    return out.where(F.col("__prev_row").isNotNull()).select(
        *keys, order, F.col("__prev_node").alias(a), F.col(node).alias(b))


def mark_changes(df: DataFrame, keys: list[str], order: str, value: str, out: str, initial, chunk: int = CHUNK) -> DataFrame:
    """``out`` holds the value where it differs from the previous row, NULL elsewhere."""
    prev = with_previous(df, keys, order, {"__pv": value}, chunk)
    differs = F.coalesce(F.col("__pv"), F.lit(initial)) != F.col(value)
    return prev.withColumn(out, F.when(differs, F.col(value))).drop("__pv")


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, out: str, default=None, chunk: int = CHUNK) -> DataFrame:
    """Last non-NULL value up to and including the row."""
    rows, large = in_parts(df, keys, order, chunk)
    filled = rows.withColumn(out, F.last(value, ignorenulls=True).over(_upto(part_window(keys, order))))
    found = [F.col(out)]
    if large is not None:
        last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(order)))
        seeds = carry(large, keys, {"__last": last}, lambda parts: {"__seed": F.last("__last", ignorenulls=True).over(_before(parts))})
        filled = join_same(filled, seeds, [*keys, PART], "left")
        found.append(F.col("__seed"))
    return filled.withColumn(out, F.coalesce(*found, *([F.lit(default)] if default is not None else []))).drop(PART, "__seed")


def _totals(rows: DataFrame, large: DataFrame | None, keys: list[str], order: str, totals: dict[str, str]) -> DataFrame:
    """Running sums over rows that have their part."""
    out = rows.withColumns({n: F.sum(c).over(_upto(part_window(keys, order))) for n, c in totals.items()})
    if large is None:
        return out
    seeds = carry(large, keys, {f"__s_{n}": F.sum(c) for n, c in totals.items()},
                  lambda parts: {f"__b_{n}": F.sum(f"__s_{n}").over(_before(parts)) for n in totals})
    out = join_same(out, seeds, [*keys, PART], "left")
    both = {n: F.when(F.col(n).isNull(), F.col(f"__b_{n}")).otherwise(F.col(n) + F.coalesce(F.col(f"__b_{n}"), F.lit(0))) for n in totals}
    return out.withColumns(both).drop(*[f"__b_{n}" for n in totals])


def running_total(df: DataFrame, keys: list[str], order: str, totals: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """Sums up to and including the row along an order; NULL until the first value."""
    rows, large = in_parts(df, keys, order, chunk)
    return _totals(rows, large, keys, order, totals).drop(PART)


def cumulative_stddev(df: DataFrame, order: str, value: str, out: str, partition_by: list[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Sample standard deviation of all values up to and including each order value (peers together).

    The values are reduced to mergeable moments per order value: count, mean and sum of squared distances from the mean. Merged in order, a
    moment adds its own squares and ``d * d * n1 * n2 / (n1 + n2)``, where ``d`` is the distance of its mean from the mean of all before it.
    Both are never negative, so nothing cancels, however far the values lie from zero. Means are added up relative to a group's least value.
    """
    keys, v = list(partition_by), F.col(value).cast("double")
    m = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("cnt"), F.avg(v).alias("avg"), F.count(v).cast("double").alias("__n"),
                                     (F.var_pop(v) * F.count(v)).alias("__q"), F.min(v).alias("__low"))
    m = materialize(m, "moments")
    least = m.groupBy(*keys).agg(F.min("__low").alias("__base"))
    if keys:
        m = join_same(m, materialize(least, "bases"), keys)
    else:
        m = m.withColumn("__base", F.lit(least.first()[0]).cast("double"))  # one number
    m = m.withColumn("__s", F.col("__n") * (F.col("avg") - F.col("__base")))
    rows, large = in_parts(m, keys, order, chunk)
    sums = _totals(rows, large, keys, order, {"__cn": "__n", "__cs": "__s"})
    n, before = F.col("__n"), F.col("__cn") - F.col("__n")
    d = F.col("avg") - F.col("__base") - F.try_divide(F.col("__cs") - F.col("__s"), before)
    added = F.coalesce(F.col("__q"), F.lit(0.0)) + F.when((before > 0) & (n > 0), d * d * F.try_divide(before * n, F.col("__cn"))).otherwise(F.lit(0.0))
    terms = sums.withColumn("__term", added)
    if large is not None:
        terms = materialize(terms, "moment-terms")
        large = join_same(terms, large.select(*keys, PART).distinct(), [*keys, PART], "left_semi")
    done = _totals(terms, large, keys, order, {"__cq": "__term"})
    sd = F.when(F.col("__cn") > 1, F.sqrt(F.try_divide(F.col("__cq"), F.col("__cn") - 1)))
    return done.select(*keys, order, "cnt", "avg", sd.alias(out))
