"""Exact grouped percentiles that never gather a group in one task.

Numbers are put in order as 64-bit integers, a double's sign, exponent and fraction. The first scan counts rows per group and leading bits,
which combines on the map side; the counts tell which leading bits hold the wanted ranks. The second scan keeps the rows with those bits only
and counts equal values. Where more than ``COUNTERS`` different values are left under the same bits, they are counted by the next twelve bits, and so on: radix
selection, with a fixed number of steps whatever the values, and never more than ``COUNTERS`` rows in a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.operators.joins import join_same
from parcelflow.session import materialize, release

BUCKETS_PER_DOUBLING = 512
INFINITE, NAN = 1 << 40, 1 << 41
#: Fixed values of the format: bits of a double's fraction, offset of its exponent, the exponent of infinity.
FRACTION, OFFSET, TOP = 52, 1023, 2047
DIGIT = 12
COUNTERS = 1 << DIGIT


def value_bucket(v: Column, per_doubling: int = BUCKETS_PER_DOUBLING) -> Column:
    """Monotone integer bucket of a number: equal steps of log2(1 + |v|); NaN comes last, as in Spark's order."""
    mag = F.least(F.floor(F.lit(float(per_doubling)) * F.log2(F.abs(v) + F.lit(1.0))), F.lit(INFINITE))
    return F.when(F.isnan(v), F.lit(NAN)).when(v < 0, -mag).otherwise(mag).cast("bigint")


def ordered_bits(v: Column) -> Column:
    """A double as a 64-bit integer of the same order: the bits of its size, negative for negative numbers; NaN comes last."""
    two = F.lit(2.0)
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    exponent = guess - F.when(F.pow(two, guess) > size, 1).otherwise(0) + F.when(F.pow(two, guess + 1) <= size, 1).otherwise(0)
    fraction = ((size / F.pow(two, exponent) - 1) * float(1 << FRACTION)).cast("bigint")
    normal = F.shiftleft((exponent + OFFSET).cast("bigint"), FRACTION) + fraction
    tiny = (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")  # below the least normal number the bits are a multiple of the least one
    bits = F.when(size == float("inf"), F.lit(TOP << FRACTION)).when(size < F.lit(2.0 ** (1 - OFFSET)), tiny).otherwise(normal)
    return F.when(F.isnan(v), F.lit((TOP << FRACTION) + (1 << (FRACTION - 1)))).when(v < 0, -bits).otherwise(bits)


def _ranks(n: Column, p: float, method: str) -> tuple[Column, Column, Column]:
    """0-based lower rank, upper rank and interpolation weight."""
    if method == "disc":
        k = F.greatest(F.ceil(F.lit(p) * n) - 1, F.lit(0)).cast("bigint")
        return k, k, F.lit(0.0)
    pos = F.lit(p) * (n - 1)
    lo = F.floor(pos)
    return lo.cast("bigint"), F.ceil(pos).cast("bigint"), pos - lo


def _holding(counts: DataFrame, within: list[str], holds: Column) -> DataFrame:
    """The rows of (within, __prefix, __n, __before, __total) that hold a wanted rank, ``__before`` moved to what precedes each of them."""
    before = F.sum("__n").over(Window.partitionBy(*within).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("__before", F.col("__before") + F.coalesce(before, F.lit(0))).where(holds)


def _under(rows: DataFrame, chosen: DataFrame, keys: list[str], shift: int) -> DataFrame:
    """The rows whose leading bits are chosen, with what ``chosen`` knows."""
    c = chosen.select(*keys, "__prefix", "__before", "__total")
    return join_same(rows.withColumn("__prefix", F.shiftright("__u", shift)), c, [*keys, "__prefix"])


def grouped_percentiles(df: DataFrame, keys: list[str], value: str, targets: dict[str, tuple[float, str]],
                        per_doubling: int = BUCKETS_PER_DOUBLING) -> DataFrame:
    """One row per group; ``targets`` maps an output to (fraction, 'cont' or 'disc'). NULL values are ignored."""
    shift = FRACTION - (per_doubling.bit_length() - 1)
    rows = df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("__v")).where(F.col("__v").isNotNull())  # no negative zero
    rows = rows.withColumn("__u", ordered_bits(F.col("__v")))
    wanted = []
    for p, method in targets.values():
        lo, hi, _ = _ranks(F.col("__total"), p, method)
        wanted += [lo, hi]
    holds = reduce(lambda a, b: a | b, [(r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")) for r in wanted])

    # first by sign and exponent, then by the leading bits of the fraction, from one scan
    hist = materialize(rows.groupBy(*keys, F.shiftright("__u", shift).alias("__prefix")).agg(F.count(F.lit(1)).alias("__n")), "percentile-counts")
    totals = hist.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    broad = hist.groupBy(*keys, F.shiftright("__prefix", FRACTION - shift).alias("__prefix")).agg(F.sum("__n").alias("__n"))
    broad = _holding(join_same(broad, totals, keys).withColumn("__before", F.lit(0).cast("bigint")) if keys else
                     broad.withColumns({"__total": F.lit(totals.first()[0]), "__before": F.lit(0).cast("bigint")}), keys, holds)
    broad = broad.select(*keys, F.col("__prefix").alias("__broad"), "__before", "__total")
    fine = join_same(hist.withColumn("__broad", F.shiftright("__prefix", FRACTION - shift)), broad, [*keys, "__broad"])
    # written, so that its true size is known: when it is small the second scan filters rows without a shuffle
    chosen = materialize(_holding(fine, [*keys, "__broad"], holds).select(*keys, "__prefix", "__before", "__total"), "percentile-bits")

    near = _under(rows, chosen, keys, shift).groupBy(*keys, "__u", "__v").agg(F.count(F.lit(1)).alias("__n"))
    near = materialize(near, "percentile-values")
    release(hist)

    def most() -> int:
        left = _under(near, chosen, keys, shift).groupBy(*keys, "__prefix").agg(F.count(F.lit(1)).alias("n"))
        return left.agg(F.max("n")).first()[0] or 0  # one number
    while shift > 0 and most() > COUNTERS:
        lower = max(0, shift - DIGIT)
        counts = _under(near, chosen, keys, shift).groupBy(*keys, F.col("__prefix").alias("__broad"), F.shiftright("__u", lower).alias("__prefix"), "__before", "__total").agg(
            F.sum("__n").alias("__n"))
        chosen, shift = materialize(_holding(counts, [*keys, "__broad"], holds).select(*keys, "__prefix", "__before", "__total"), "percentile-bits"), lower

    near = _under(near, chosen, keys, shift)
    upto = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__prefix").orderBy("__u").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__n"))
    aggs, finals = [], []
    for out, (p, method) in targets.items():
        lo, hi, w = _ranks(F.col("__total"), p, method)
        at = lambda r: F.max(F.when((r >= F.col("__from")) & (r < F.col("__to")), F.col("__v")))
        aggs += [at(lo).alias(f"__lo_{out}"), at(hi).alias(f"__hi_{out}"), F.max(w).alias(f"__w_{out}")]
        between = F.col(f"__lo_{out}") + (F.col(f"__hi_{out}") - F.col(f"__lo_{out}")) * F.col(f"__w_{out}")
        finals.append(F.when((F.col(f"__lo_{out}") == F.col(f"__hi_{out}")) | (F.col(f"__w_{out}") == 0), F.col(f"__lo_{out}")).otherwise(between).alias(out))
    return near.groupBy(*keys).agg(*aggs).select(*keys, *finals)


def approximate_percentiles(df: DataFrame, keys: list[str], value: str, targets: dict[str, float],
                            accuracy: int = 10000) -> DataFrame:
    """One-pass sketch for when a rank error of 1/accuracy is acceptable."""
    return df.groupBy(*keys).agg(*[F.percentile_approx(value, p, accuracy).alias(o) for o, p in targets.items()])


def percentile_over(df: DataFrame, keys: list[str], value: str, out: str, p: float) -> DataFrame:
    """The analytic form: every row carries its group's percentile."""
    return join_same(df, grouped_percentiles(df, keys, value, {out: (p, "cont")}), keys, "left")
