import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import geometry as G
from parcelflow.functions import scalars as S
from parcelflow.operators import aggregates as A
from parcelflow.operators import joins as J
from parcelflow.operators import percentiles as P
from parcelflow.operators import profiles, spatial
from parcelflow.operators import windows as W


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("v")).first().v


# ------------------------------------------------------------------ expressions

def test_bands_and_nulls(spark):
    df = spark.createDataFrame([(14999,), (15000,), (75000,), (None,)], "v int")
    assert [r[0] for r in df.select(S.band("v", K.INCOME_EDGES)).collect()] == [1, 2, 5, None]
    assert [r[0] for r in df.select(S.band("v", K.INCOME_EDGES, "right")).collect()] == [1, 1, 4, None]


def test_vehicle_share_rules(spark):
    rows = [(m, d) for m in (1, 2, 3, 4, 5, 6, 8, 9) for d in (1, 3, 11, 12, 13, 21, 22, 23, None)]
    df = spark.createDataFrame(rows, "mode int, dorp int").withColumn("v", F.lit(10.0))
    got = {(r.mode, r.dorp): (r.c, r.d, r.a, r.t) for r in df.select(
        "mode", "dorp", *[S.vehicle_share("mode", "dorp", "v", k).alias(n) for n, k in (("c", "constants"), ("d", "dorp"), ("a", "dorp_av"), ("t", "telework"))]).collect()}
    assert got[3, None][0] == 10 and got[4, 1][0] == 5 and got[5, 1][0] == 3 and got[6, 1][0] == 0
    assert math.isclose(got[9, 11][0], 14) and math.isclose(got[9, 22][0], 7) and math.isclose(got[9, 13][0], 3.5) and got[9, 1][0] == 0
    assert got[9, 1][1] == 10 and got[9, 3][1] == 0 and got[9, 3][2] == 10 and got[1, 1][1] == 0 and got[9, None][3] == 6
    with pytest.raises(ValueError):
        S.vehicle_share("mode", "dorp", "v", "other")


def test_speed_and_emission_bins(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,), (60.0,), (60.1,), (None,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(S.speed_bin_factor("s")).collect()] == [0.0, 1251.4, 937.0, 446.0, 503.3, 0.0, 0.0]
    t = spark.createDataFrame([(3, 0.5, 10.0, 1.0, 5.0), (1, 0.5, 10.0, 1.0, 5.0), (3, 0.0, 10.0, 1.0, 5.0), (1, 0.5, 1.0, None, 5.0)],
                              "mode int, ta double, da double, tt double, td double")
    assert [r[0] for r in t.select(S.trip_speed("mode", "ta", "da", "tt", "td")).collect()] == [20.0, 5.0, 20.0, 20.0]


def test_null_sensitive_expressions(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (None, None), (3.0, 2.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(S.min_distance("a", "b")).collect()] == [None, 2.0, -1.0, 2.0, 1.0]
    assert [r[0] for r in df.select(S.sum_unless_both_null("a", "b")).collect()] == [None, None, 0.0, 5.0, 3.0]
    assert one(spark, S.mix_index("h", [(1.0, 2.0, F.col("x"))]), h=0.0, x=1.0) == -1.0
    assert one(spark, S.mix_index("h", [(0.5, 2.0, F.col("x"))]), h=10.0, x=5.0) == 0.125


def test_mix_density_levels(spark):
    acre = K.HALF_MILE_ACRES
    cases = [(8 * acre, 0, 1), (9 * acre, 0, 2), (17 * acre, 0, 3), (0, acre, 4), (0, 10 * acre, 5), (0, 20 * acre, 6),
             (acre, acre, 7), (5 * acre, 5 * acre, 8), (9 * acre, 9 * acre, 9), (0, 0, 0)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b, _ in cases], "h double, e double")
    assert [r[0] for r in df.select(S.mix_density("h", "e")).collect()] == [c for _, _, c in cases]


def test_road_rules(spark):
    df = spark.createDataFrame([(5, .84), (5, .85), (2, .84), (2, 1.1), (2, 1.11), (26, .9), (51, .86), (7, 2.0), (1, None)], "c int, v double")
    assert [r[0] for r in df.select(S.road_utilization("c", "v")).collect()] == [2, 3, 1, 2, 3, 2, 3, 0, 0]
    lv = spark.createDataFrame([(.5, .5), (.9, .2), (1.05, .2), (.95, 1.2), (1.2, 1.2)], "a double, p double")
    assert [r[0] for r in lv.select(S.congestion_level("a", "p")).collect()] == [1, 2, 3, 2, 3]
    ph = spark.createDataFrame([(1, 1, 0, 0, 1.0, .1, .1), (2, 3, 1, 0, 1.0, .1, .1), (1, 1, 1, 0, 1.4, .6, .1), (3, 3, 1, 1, 1.0, .1, .1),
                                (3, 1, 1, 1, 1.0, .8, .1), (1, 2, 1, 2, 1.0, .1, .1)], "b int, f int, p int, n int, r double, a double, m double")
    assert [r[0] for r in ph.select(S.phasing_code("b", "f", "p", "n", "r", "a", "m")).collect()] == [1, 16, 10, 29, 20, 2]


def test_directions_and_times(spark):
    df = spark.createDataFrame([(-180.0,), (-135.0,), (-45.0,), (44.9,), (45.0,), (134.9,), (135.0,), (180.0,)], "a double")
    assert "".join(r[0] for r in df.select(S.cardinal_direction("a")).collect()) == "WSEENNWW"
    t = spark.createDataFrame([("25:10:00",), (None,), ("05:00:00",)], "t string").select(S.minutes_after_midnight("t").alias("m"))
    assert [(r.m, r.c, r.p) for r in t.select("m", S.clock_text("m").alias("c"), S.period_of("m").alias("p")).collect()] == [
        (1510, "25:10", 6), (0, "0:00", 99), (300, "5:00", 1)]
    h = spark.createDataFrame([("2024-01-02 19:59:00",), ("2024-01-02 20:00:00",), ("2024-01-03 05:59:59",), ("2024-01-03 06:00:00",)], "s string")
    h = h.select(F.to_timestamp("s").alias("t"))
    assert [r[0] for r in h.select(S.hour_window("t", 20, 6)).collect()] == [False, True, True, False]
    assert [r[0] for r in h.select(S.weekday_filter("t", ["Tuesday"])).collect()] == [True, True, False, False]


def test_text_helpers(spark):
    df = spark.createDataFrame([("abc",), ("1.5",), ("-7",), ("1.2.3",), ("12%",)], "t string")
    got = [(r.s.kind, r.s.whole, r.s.real, r.s.text) for r in df.select(S.infer_scalar("t").alias("s")).collect()]
    assert got == [("text", None, None, "abc"), ("real", None, 1.5, None), ("whole", -7, None, None), ("text", None, None, "1.2.3"), ("text", None, None, "12%")]
    n = spark.createDataFrame([(1234567.5,), (999.996,), (12.3456,)], "v double")
    assert [r[0] for r in n.select(S.display_number("v")).collect()] == ["1,234,568", "1000.0", "12.35"]
    k = spark.createDataFrame([("a.b---Mon Jan 01 2024 00-00-00 .net",), ("plain---x",)], "k string")
    assert [r[0] for r in k.select(S.original_file_name("k")).collect()] == ["a.b.net", "plain.txt"]
    assert one(spark, S.strip_suffix(F.lit("A_B_A"), K.DIRECTION_TAGS)) == "A_B"
    assert one(spark, S.attribute_prefix(F.lit("CAPC35_DPS"))) == "CAPC" and one(spark, S.attribute_year(F.lit("CAPC35_DPS"))) == 2035


# ------------------------------------------------------------------ aggregates

def test_weighted_and_harmonic(spark):
    df = spark.createDataFrame([("a", 10.0, 1.0), ("a", None, 5.0), ("a", 20.0, 3.0), ("b", 1.0, 0.0)], "k string, v double, w double")
    got = dict((r.k, r.m) for r in A.weighted_average(df, ["k"], {"m": ("v", "w")}).collect())
    assert got == {"a": 17.5, "b": None}
    h = dict((r.k, r.h) for r in df.groupBy("k").agg(A.harmonic_mean("v").alias("h")).collect())
    assert math.isclose(h["a"], 3 / 0.15) and h["b"] == 1.0


def test_allocation_preserves_totals(spark):
    random.seed(1)
    parts = spark.createDataFrame([(i, i % 5 if i % 3 else 0, float(random.randint(0, 9))) for i in range(300)] + [(999, 7, 0.0)], "p int, z int, w double")
    totals = spark.createDataFrame([(z, 100.0 * (z + 1)) for z in range(9)], "z int, m double")
    out = A.allocate_share(parts, totals, "z", {"w": ("s", ["m"])})
    sums = {r.z: r.t for r in out.groupBy("z").agg(F.sum("m").alias("t")).collect()}
    for z in range(5):
        assert math.isclose(sums[z], 100.0 * (z + 1))
    assert sums[7] == 0.0 and 8 not in sums


def test_reconcile_and_match_rate(spark):
    same = A.reconcile_counts({"a": spark.range(3), "b": spark.range(3)}).collect()
    assert {(r.check_name, r.n_rows, r.mismatch) for r in same} == {("a", 3, False), ("b", 3, False)}
    assert all(r.mismatch for r in A.reconcile_counts({"a": spark.range(3), "b": spark.range(2)}).collect())
    d = spark.createDataFrame([(1, 5), (2, None), (6, None)], "c int, m int")
    assert tuple(A.match_rate(d, "c", "m", [1, 2]).first()) == (3, 2, 1, 50.0)
    none = A.roadway_totals(None, spark).first()
    assert none["DAYVMT_tot"] == -1 and none["DAYCVMT_nongtwy"] == -1
    trips = spark.createDataFrame([(3, 1, 2.0)], "mode int, dorp int, distau double")
    assert A.resident_vmt(trips).first().vmt == 2.0  # modes 4 and 5 missing


def test_first_changed_year(spark):
    df = spark.createDataFrame([(1, 5, 5, 6, 5, 5), (2, 5, 6, 5, 5, 7), (3, None, None, 1, None, 5)], "k int, SPD16 int, SPD20 int, SPD35 int, SPD35_DPS int, SPD40_DPS int")
    got = [r[1] for r in A.first_changed_year(df, ["k"], ["SPD"], 16).orderBy("k").collect()]
    assert got == [2035, 2020, 2035]
    df = df.drop("SPD35")
    assert [r[1] for r in A.first_changed_year(df, ["k"], ["SPD"], 16).orderBy("k").collect()] == [None, 2020, 2040]


def test_profile(spark):
    df = spark.createDataFrame([(1, 200, 0.5, "a"), (100, 70000, 0.25, "a"), (3, 3, 1.0, "a")], "a long, b long, c double, d string")
    out, cats = profiles.narrow_types(df)
    assert [t for _, t in out.dtypes] == ["tinyint", "int", "float", "string"] and cats == ["d"]


# ------------------------------------------------------------------ percentiles

@pytest.mark.parametrize("kind", ["continuous", "ties", "negative", "wide"])
def test_percentiles_match_numpy(spark, kind):
    rng = np.random.default_rng(3)
    values = {"continuous": rng.normal(60, 10, 3000), "ties": rng.integers(0, 4, 3000) / 1.0, "negative": rng.normal(0, 1e-3, 3000),
              "wide": np.exp(rng.normal(0, 9, 3000))}[kind]
    keys = np.where(rng.random(3000) < 0.5, 0, rng.integers(1, 20, 3000))  # one hot group
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)] + [(50, None), (51, 2.5), (0, None)], "k int, v double")
    got = P.grouped_percentiles(df, ["k"], "v", {"p85": (0.85, "cont"), "p60": (0.6, "cont"), "d25": (0.25, "disc")}).collect()
    assert {r.k for r in got} == {int(k) for k in set(keys)} | {51}
    for r in got:
        mine = [2.5] if r.k == 51 else values[keys == r.k]
        for p, q in ((r.p85, .85), (r.p60, .6)):
            assert math.isclose(p, float(np.quantile(mine, q)), rel_tol=1e-12, abs_tol=1e-15)
        assert r.d25 == float(np.quantile(mine, .25, method="inverted_cdf"))


@pytest.mark.parametrize("values", [[10.0, 20.0, 30.0, 40.0, float("nan")], [float("-inf"), 1.0, 2.0, float("inf"), float("inf")]])
def test_percentiles_of_unusual_numbers(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for p in (0.0, 0.25, 0.5, 0.6, 1.0):
        got = P.grouped_percentiles(df.selectExpr("1 AS k", "v"), ["k"], "v", {"x": (p, "cont")}).first().x
        want = df.selectExpr(f"percentile(v, {p}) AS x").first().x
        assert got == want or (math.isnan(got) and math.isnan(want))


def test_percentiles_of_values_that_share_a_bucket(spark):
    for v in ("id / 1e9", "1700000000 + id / 7"):
        df = spark.range(20_000).selectExpr("1 AS k", f"CAST({v} AS DOUBLE) AS v")
        assert df.select(P.value_bucket(F.col("v"))).distinct().count() <= 2
        got = P.grouped_percentiles(df, ["k"], "v", {"x": (0.35, "cont"), "y": (0.9, "disc")}).first()
        want = df.selectExpr("percentile(v, 0.35) AS x", "percentile_disc(0.9) WITHIN GROUP (ORDER BY v) AS y").first()
        assert math.isclose(got.x, want.x, rel_tol=1e-12) and got.y == want.y


def test_ordered_bits(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.0 - 2 ** -53, 2.0, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 2 ** 52 + 1.0]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values += [2.0 ** rng.randint(-1070, 1020) * (1 + rng.choice([0, 1, -1]) * 2 ** -52) for _ in range(500)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values] + [(float("nan"),)], "v double").select("v", P.ordered_bits(F.col("v")).alias("u")).collect()
    for r in df:
        if not math.isnan(r.v):
            bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
            assert r.u == (-bits if r.v < 0 else bits), r.v
    assert max(df, key=lambda r: r.u).v != max(df, key=lambda r: r.u).v  # NaN


def test_percentiles_of_many_values_under_the_same_bits(spark):
    """Log-spread fractions, neighbours of one number, one hot value: no window over more than 4096 rows, by the event counts of each step."""
    df = spark.range(30_000).selectExpr("id % 2 AS k", "CASE WHEN id % 2 = 0 THEN 1 + id * pow(2D, -52) WHEN id % 3 = 0 THEN pow(10D, -(id % 997)) ELSE 7.5 END AS v")
    seen, plain = [], P._holding
    try:
        P._holding = lambda counts, within, holds: seen.append(counts.groupBy(*within).count().agg(F.max("count")).first()[0]) or plain(counts, within, holds)
        got = {r.k: r for r in P.grouped_percentiles(df, ["k"], "v", {"a": (0.31, "cont"), "b": (0.9, "disc"), "c": (0.0, "cont")}).collect()}
    finally:
        P._holding = plain
    want = {r.k: r for r in df.groupBy("k").agg(F.expr("percentile(v, 0.31)").alias("a"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY v)").alias("b"),
                                                F.min("v").alias("c")).collect()}
    for k in (0, 1):
        assert math.isclose(got[k].a, want[k].a, rel_tol=1e-15) and got[k].b == want[k].b and got[k].c == want[k].c
    assert max(seen) <= P.COUNTERS and len(seen) >= 3
    whole = P.grouped_percentiles(df, [], "v", {"a": (0.5, "cont")}).first().a
    assert math.isclose(whole, df.selectExpr("percentile(v, 0.5) AS a").first().a, rel_tol=1e-15)


def test_percentiles_null_key_and_coarse_buckets(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(101)] + [("a", 1.0)], "k string, v double")
    got = {r.k: r.m for r in P.grouped_percentiles(df, ["k"], "v", {"m": (0.5, "cont")}, per_doubling=1).collect()}
    assert got == {None: 50.0, "a": 1.0}


# ------------------------------------------------------------------ ordered operators

def test_chunked_operators_equal_plain_windows(spark):
    from pyspark.sql import Window
    random.seed(5)
    rows = [(random.choice("aaab"), i, random.choice([None, "x", "y"]), i % 7) for i in random.sample(range(-50, 4000), 900)]
    df = spark.createDataFrame(rows, "k string, o int, v string, n int")
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.lag("n").over(w).alias("p"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                     F.sum("n").over(w).alias("t"))
    for chunk in (7, 500, 100000):
        got = W.with_previous(df, ["k"], "o", {"p": "n"}, chunk)
        got = W.carry_forward(got, ["k"], "o", "v", "c", chunk=chunk)
        got = W.running_total(got, ["k"], "o", {"t": "n"}, chunk).select("k", "o", "p", "c", "t")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ordered_operators_of_any_key_and_order(spark):
    """NULL keys, orders by microseconds and by text, a NULL order, keys of two columns, no key at all."""
    from pyspark.sql import Window
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), i % 2 if i % 7 else None, 1_700_000_000_000_000 + i * 7 if i else None, f"{rng.random():.9f}", rng.choice([None, "x", "y"]), i % 5)
            for i in rng.sample(range(0, 5000), 700)]
    df = spark.createDataFrame(rows, "k string, j int, o long, t string, v string, n int")
    for keys, order, chunk in ((["k"], "o", 40), (["k", "j"], "t", 25), ([], "o", 100), (["k"], "t", 10_000)):
        w = Window.partitionBy(*keys).orderBy(order)
        want = df.select("o", "t", F.lag("n").over(w).alias("p"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
                         F.sum("n").over(w).alias("s"), F.when(F.coalesce(F.lag("n").over(w), F.lit(9)) != F.col("n"), F.col("n")).alias("m"))
        got = W.with_previous(df, keys, order, {"p": "n"}, chunk)
        got = W.carry_forward(got, keys, order, "v", "c", chunk=chunk)
        got = W.running_total(got, keys, order, {"s": "n"}, chunk)
        got = W.mark_changes(got, keys, order, "n", "m", 9, chunk).select("o", "t", "p", "c", "s", "m")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), (keys, order)
        pairs = W.consecutive_pairs(df, keys, order, "n", chunk=chunk)
        assert pairs.count() == len(rows) - max(1, df.select(*keys, F.lit(1)).distinct().count())


def test_parts_of_a_large_group_are_no_more_than_tasks(spark):
    df = spark.range(3000).selectExpr("id % 2 AS k", "id AS o", "CAST(id AS DOUBLE) AS v")
    rows, large = W.in_parts(df, ["k"], "o", chunk=1)
    assert 1 < large.select(W.PART).distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows.count() == 3000
    total = W.running_total(df, ["k"], "o", {"t": "v"}, chunk=1)
    assert {(r.o, r.t) for r in total.collect()} == {(o, float(sum(range(o % 2, o + 1, 2)))) for o in range(3000)}


def test_no_task_orders_a_whole_large_group(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN id ELSE NULL END AS k", "CAST(1e15 AS BIGINT) + id * id AS o")  # two thirds under a NULL key
    rows, large = W.in_parts(df, ["k"], "o", 1000)
    sizes = [r["count"] for r in large.groupBy("k", W.PART).count().collect()]
    assert len(sizes) >= 13 and max(sizes) <= 2000 and sum(sizes) == 13_333
    assert rows.count() == 20_000 and rows.where(f"k IS NOT NULL AND {W.PART} <> 0").isEmpty()
    ends = large.groupBy(W.PART).agg(F.min("o").alias("a"), F.max("o").alias("b")).orderBy(W.PART).collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    assert W.in_parts(df.where("k IS NOT NULL"), ["k"], "o", 1000)[1] is None


@pytest.mark.parametrize("chunk", [2, 7, 10_000])
def test_moments_do_not_cancel(spark, chunk):
    rng = np.random.default_rng(9)
    values = [1e9, 1e9 + 1, 1e9 + 2] + rng.uniform(-1, 1, 30).tolist() + [1e12, 1e12 + 1] + [-1e9 + x for x in range(5)]
    df = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate(values)] + [("a", 1, None), ("c", 1, None), ("c", 2, 5.0)], "k string, o int, v double")
    got = {(r.k, r.o): r for r in W.cumulative_stddev(df, "o", "v", "sd", ["k"], chunk).collect()}
    for k in ("a", None):
        assert got[k, 0].sd is None and math.isclose(got[k, 1].sd, math.sqrt(0.5), rel_tol=1e-12) and math.isclose(got[k, 2].sd, 1.0, rel_tol=1e-12)
        from decimal import Decimal
        for i in range(1, len(values)):
            d = [Decimal(v) for v in values[:i + 1]]
            mean = sum(d) / len(d)
            assert math.isclose(got[k, i].sd, float((sum((x - mean) ** 2 for x in d) / (len(d) - 1)).sqrt()), rel_tol=1e-7)
    assert got["a", 1].cnt == 2 and got["c", 1].sd is None and got["c", 2].sd is None
    whole = {r.o: r.sd for r in W.cumulative_stddev(df.where("k = 'a'"), "o", "v", "sd", (), chunk).collect()}
    assert math.isclose(whole[2], 1.0, rel_tol=1e-12)


def test_cumulative_stddev_literals(spark):
    rng = np.random.default_rng(5)
    vals = {k: rng.uniform(0, 50, n).tolist() for k, n in (("a", 4), ("b", 1), ("c", 9))}
    df = spark.createDataFrame([(ord(k), v) for k, vs in vals.items() for v in vs], "g int, v double")
    got = {chr(r.g): (r.cnt, r.sd) for r in W.cumulative_stddev(df, "g", "v", "sd").collect()}
    seen = []
    for k, vs in vals.items():
        seen += vs
        assert got[k][0] == len(vs) and math.isclose(got[k][1], float(np.std(seen, ddof=1)), rel_tol=1e-9)


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), ("a", 9), ("b", 3), ("c", 1), ("c", 2), ("d", None)], "k string, v int")
    got = {r.k: (r.x, r.y) for r in W.first_two(df, ["k"], "v", "x", "y").collect()}
    assert got == {"a": (5, 5), "b": (3, None), "c": (1, 2)}
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y")], "k string, o int, t string")
    assert tuple(W.first_per_key(d, ["k"], ["o"]).first()) == ("a", 1, "y")


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 15.0)], "k string, v double")
    assert sorted(r.n for r in W.group_stats(df, ["k"], {"n": F.sum("v")}).collect()) == [4.0, 4.0, 20.0, 20.0]
    assert sorted(r.s for r in A.share_of_total(df, ["k"], "v", "s").collect()) == [0.25, 0.25, 0.75, 0.75]
    assert sorted(r.p for r in P.percentile_over(df, ["k"], "v", "p", 0.5).collect()) == [2.0, 2.0, 10.0, 10.0]


# ------------------------------------------------------------------ joins

def test_pair_status(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 5), (6, 6), (7, 8)], "A int, B int")
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (5, 5)], "A int, B int")
    got = {(r.A, r.B): r.LINK_HWYNET_STATUS for r in J.pair_status(pairs, links).collect()}
    assert got == {(1, 2): "OK", (2, 1): "OK", (3, 4): "OK", (4, 3): "CHECK_DIR", (5, 5): "OK", (6, 6): "LINK_MISSING", (7, 8): "LINK_MISSING"}


def test_contained_sets_brute_force(spark):
    random.seed(9)
    sets = {i: set(random.sample(range(12), random.randint(1, 6))) for i in range(60)}
    df = spark.createDataFrame([(o, x) for o, s in sets.items() for x in s], "o int, i int")
    got = {tuple(r) for r in J.contained_sets(df, "o", "i").collect()}
    assert got == {(a, b) for a in sets for b in sets if a != b and (sets[a] <= sets[b] or sets[b] <= sets[a])}


def test_contained_large_sets_meet_few_others(spark):
    """Sets of 50 and more with many common items, copies of one set: few pairs are formed."""
    rng = random.Random(2)
    big = {i: set(rng.sample(range(400), 120)) | set(range(1000, 1030)) for i in range(60)}
    sets = big | {100 + i: set(rng.sample(sorted(big[i]), 60)) for i in range(30)} | {200 + i: set(big[0]) for i in range(20)} | {300: {1000}, 301: set()}
    df = spark.createDataFrame([(o, x) for o, s in sets.items() for x in s] + [(301, None), (5, None)], "o int, i int")
    seen, plain = [], J._containers
    try:
        J._containers = lambda *a: seen.append(plain(*a).count()) or plain(*a)
        got = [tuple(r) for r in J.contained_sets(df, "o", "i").collect()]
    finally:
        J._containers = plain
    some = {o: s for o, s in sets.items() if s}
    assert sorted(got) == sorted((a, b) for a in some for b in some if a != b and (some[a] <= some[b] or some[b] <= some[a]))
    assert seen[0] < 200 + len(big) + 30  # the set {1000} is in all; of the 30 others each is in one or two


def test_sets_with_one_item_in_common_leave_no_pair(spark):
    """Sets of several items that share their rarest one: the hashed items tell them apart before pairs are moved."""
    sets = {i: {0, *range(1 + 3 * i, 4 + 3 * i)} for i in range(40)} | {100: {0}, 101: {0, 1, 2}, 102: {0, 1, 2}}
    df = spark.createDataFrame([(o, x) for o, s in sets.items() for x in s], "o int, i int")
    classes = J._set_classes(df.toDF("__o", "__i"))
    assert {r["__o"]: r["__class"] for r in classes.collect()}[102] == 101
    one = classes.where("__o = __class").drop("__class")
    all_sets = df.toDF("__o", "__i").join(one, "__o").withColumnRenamed("__o", "__class")
    rare = all_sets.where("__i = 0").withColumn("__at", F.lit(1))
    assert J._containers(all_sets, rare, 1).count() < 100  # of 1722 pairs by the item alone; 42 are for the set {0}
    got = {tuple(r) for r in J.contained_sets(df, "o", "i").collect()}
    assert got == {(a, b) for a in sets for b in sets if a != b and (sets[a] <= sets[b] or sets[b] <= sets[a])}


def test_only_in_each_sorts_once_in_all_tasks(spark):
    """Repeated rows, NULL keys and other columns stay; one sort, and no partition is put together with others."""
    left = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "b", 2), (None, "c", 3), (3, "d", 4)], "k int, m string, v int")
    right = spark.createDataFrame([(2, "b", 9), (3, "x", 8), (None, "c", 7), (3, "x", 6)], "k int, m string, v int")
    out = J.only_in_each(left, right, ["k", "m"], ("same", "same"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [
        (1, "a", 1, "same"), (1, "a", 1, "same"), (None, "c", 3, "same"), (3, "d", 4, "same"), (3, "x", 8, "same"), (None, "c", 7, "same"), (3, "x", 6, "same")]))
    assert out.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_keep_all(spark):
    dim = spark.createDataFrame([(1,), (2,)], "k int")
    s = spark.createDataFrame([(1, None, 4)], "k int, a int, b int")
    assert {tuple(r) for r in J.keep_all(dim, s, "k", zero=["a"]).collect()} == {(1, None, 4), (2, 0, None)}


# ------------------------------------------------------------------ geometry

def pt(x, y):
    return {"x": float(x), "y": float(y)}


def rings(spark, named):
    return spark.createDataFrame([(i, [pt(*p) for p in r]) for i, r in named.items()], "id int, ring array<struct<x:double,y:double>>")


def raster_area(a, b, n=600):
    allp = np.array(a + b)
    (x0, y0), (x1, y1) = allp.min(0), allp.max(0)
    gx, gy = np.meshgrid(x0 + (np.arange(n) + .5) * (x1 - x0) / n, y0 + (np.arange(n) + .5) * (y1 - y0) / n)

    def inside(ring):
        r = np.zeros_like(gx, bool)
        for (px, py), (qx, qy) in zip(ring, ring[1:] + ring[:1]):
            if py != qy:
                r ^= ((py > gy) != (qy > gy)) & (gx < px + (gy - py) * (qx - px) / (qy - py))
        return r
    return (inside(a) & inside(b)).mean() * (x1 - x0) * (y1 - y0)


def star(rng, cx, cy, n, r):
    ang = np.sort(rng.random(n)) * 2 * np.pi
    rad = r * (0.35 + 0.65 * rng.random(n))
    return [(float(cx + a * np.cos(t)), float(cy + a * np.sin(t))) for a, t in zip(rad, ang)]


def test_overlay_concave(spark):
    rng = np.random.default_rng(4)
    off = 2_000_000.0  # state-plane sized coordinates
    parts = {i: star(rng, off + 3 * (i % 4), off + 3 * (i // 4), 9, 2.2) for i in range(12)}
    zones = {i: star(rng, off + 5 * (i % 2), off + 5 * (i // 2), 11, 4.5)[::(-1 if i % 2 else 1)] for i in range(4)}
    zones[9] = [(off + 1, off), (off + 9, off), (off + 9, off + 9), (off + 5, off + 2), (off + 1, off + 9), (off + 1, off)]  # closed, concave
    p = rings(spark, parts).withColumnsRenamed({"id": "parcelid", "ring": "part_ring"})
    z = rings(spark, zones).withColumnsRenamed({"id": "zone_id", "ring": "zone_ring"})
    for cell in (2.0, 50.0):
        got = {(r.parcelid, r.zone_id): (r.piece_area, r.part_area) for r in spatial.overlay(p, z, cell).collect()}
        for i, a in parts.items():
            for j, b in zones.items():
                want = raster_area([(x - off, y - off) for x, y in a], [(x - off, y - off) for x, y in (b[:-1] if b[0] == b[-1] else b)])
                assert abs(got.get((i, j), (0, 0))[0] - want) < 0.08
    cover = {0: [(off - 50, off - 50), (off + 50, off - 50), (off + 1, off + 50), (off + 0, off + 50), (off - 50, off + 50)],
             1: [(off + 50, off - 50), (off + 50, off + 50), (off + 1, off + 50)]}
    z2 = rings(spark, cover).withColumnsRenamed({"id": "zone_id", "ring": "zone_ring"})
    total = spatial.overlay(p, z2, 10.0).groupBy("parcelid").agg(F.sum("piece_area").alias("s"), F.first("part_area").alias("a")).collect()
    assert len(total) == len(parts) and all(math.isclose(r.s, r.a, rel_tol=1e-6) for r in total)


def edge_d(x, y, a, b):
    a, b, q = np.array(a), np.array(b), np.array([x, y])
    l2 = ((b - a) ** 2).sum()
    t = 0 if l2 == 0 else np.clip(((q - a) * (b - a)).sum() / l2, 0, 1)
    return float(np.hypot(*(q - (a + t * (b - a)))))


@pytest.mark.parametrize("dense", [50_000, 5])
def test_nearest_line_brute_force(spark, dense):
    rng = np.random.default_rng(8)
    pts = [(i, "k" if i % 3 else "m", float(x), float(y)) for i, (x, y) in enumerate(rng.random((150, 2)) * 100)]
    pts += [(900 + i, "k", 50.0, 50.0) for i in range(40)]  # copies of one place
    lines = []
    for i in range(60):
        p = rng.random(2) * 100
        path = [tuple(map(float, p))]
        for _ in range(1 + i % 3):
            p = p + rng.normal(0, 25 if i % 10 == 0 else 6, 2)
            path.append(tuple(map(float, p)))
        lines.append((i, "k" if i % 2 else "m", float(i % 4), path))
    lines += [(200, "k", 3.0, lines[1][3]), (201, "k", 99.0, lines[3][3])]  # copies of two lines
    P_ = spark.createDataFrame(pts, "link_id int, c string, x double, y double")
    L_ = spark.createDataFrame([(i, c, m, [pt(*q) for q in path]) for i, c, m, path in lines],
                               "seg_id int, c string, miles double, points array<struct<x:double,y:double>>")
    got = {r.link_id: r for r in spatial.nearest_line(P_, L_, ["c"], [spatial.Search(9.0)], dense=dense).collect()}
    for i, c, x, y in pts:
        cand = sorted((min(edge_d(x, y, a, b) for a, b in zip(path, path[1:])), -m, sid) for sid, k, m, path in lines if k == c)
        cand = [q for q in cand if q[0] <= 9.0]
        if not cand:
            assert i not in got
            continue
        best = [q for q in cand if q[0] - cand[0][0] < 1e-9]
        best.sort(key=lambda q: (q[1], q[2]))
        assert got[i].seg_id == best[0][2] and math.isclose(got[i].distance, cand[0][0], rel_tol=1e-9, abs_tol=1e-9)
        assert got[i].tied == (len(best) > 1 and best[0][1] == best[1][1])


def crowd(spark, n_edges, n_points, seed=5, spread=100.0):
    rng = np.random.default_rng(seed)
    a, turn = rng.random((n_edges, 2)) * spread, rng.integers(0, 4, n_edges)
    step = np.array([[1, 0.1], [0.1, 1], [-1, 0.1], [0.1, -1]])[turn]
    lines = [(i, "NESW"[t], float(i % 5), float(t * 90), [pt(*map(float, p)), pt(*map(float, p + d))]) for i, (p, d, t) in enumerate(zip(a, step, turn))]
    pts = [(i, "NESW"[i % 4], float(i % 4 * 90), float(x), float(y)) for i, (x, y) in enumerate(rng.random((n_points, 2)) * spread)]
    return (spark.createDataFrame(pts, "link_id int, dir string, angle double, x double, y double").withColumn("c", F.lit(1)),
            spark.createDataFrame(lines, "seg_id int, dir string, miles double, angle double, points array<struct<x:double,y:double>>").withColumn("c", F.lit(1)), pts, lines)


def test_searches_read_few_candidates(spark):
    """Each search reads few edges a point: its own keys, and only cells within the bound; same results for any size of cell."""
    P_, L_, pts, lines = crowd(spark, 3000, 300)
    s = [spatial.Search(6.0, same=("dir",)), spatial.Search(6.0, angle_tolerance=10), spatial.Search(12.0, angle_tolerance=10)]
    seen, plain, found = [], spatial._candidates, []
    try:
        for dense in (256, 8):
            spatial._candidates = lambda a, b, on: seen.append(plain(a, b, on).count()) or plain(a, b, on)
            found.append(sorted(map(tuple, spatial.nearest_line(P_, L_, ["c"], s, dense=dense).collect())))
            if dense == 256:
                first = sum(seen)
    finally:
        spatial._candidates = plain
    assert found[0] == found[1] and len(found[0]) == 300 and {r[4] for r in found[0]} == {1}
    pairs = sum(abs(px - q["x"]) <= 12 and abs(py - q["y"]) <= 12 for *_, px, py in pts for q in (line[4][0] for line in lines))
    assert 4 * first <= pairs and 4 * (sum(seen) - first) <= pairs


def test_only_edges_within_the_bound_are_sorted(spark):
    """Of the edges within reach of a place, only those as near as the nearest of its own cell go on to be sorted, however many there are."""
    P_, L_, pts, lines = crowd(spark, 3000, 300, spread=30.0)
    seen, plain = [], spatial._best
    spatial._best = lambda near, loc: seen.append(near.count()) or plain(near, loc)
    try:
        got = {r.link_id: r.distance for r in spatial.nearest_line(P_, L_, ["c"], [spatial.Search(6.0)]).collect()}
    finally:
        spatial._best = plain
    ends = [tuple((q["x"], q["y"]) for q in line[4]) for line in lines]
    each = [[edge_d(x, y, a, b) for a, b in ends] for *_, x, y in pts[:20]]
    assert sum(d <= 6.0 for ds in each for d in ds) > 100 * len(each)
    assert all(math.isclose(got[p[0]], min(ds), abs_tol=1e-9) for p, ds in zip(pts, each))
    assert seen[0] <= 3 * len(pts)


def test_directory_splits_crowded_cells(spark):
    _, L_, _, _ = crowd(spark, 4000, 1, spread=20.0)
    e = L_.select("c", F.explode(G.edges("points")).alias("e")).select("c", "e.*")
    cells, levels = spatial._directory(e, ["c"], F.lit(16.0), 50)
    assert levels[-1] == cells.agg(F.max("level")).first()[0]
    sizes = cells.groupBy("c", "level", "__cx", "__cy").count().collect()
    assert max(r["count"] for r in sizes) <= 50 and len({r.level for r in sizes}) > 1
    boxes = sorted((r["__cx"] * 16 / 2 ** r.level, r["__cy"] * 16 / 2 ** r.level, 16 / 2 ** r.level) for r in sizes)
    assert not any(x < u + v and u < x + w and y < z + v and z < y + w for i, (x, y, w) in enumerate(boxes) for u, z, v in boxes[i + 1:i + 60])  # none overlap
    assert cells.select("x1", "y1", "x2", "y2").distinct().count() == e.distinct().count()
    knot = spark.createDataFrame([(1, 0.0, 0.0, math.cos(a), math.sin(a)) for a in range(40)], "c int, x1 double, y1 double, x2 double, y2 double")
    assert spatial._directory(knot, ["c"], F.lit(8.0), 10)[0].where(f"level = {spatial.DEEPEST}").count() >= 10  # edges that meet in one point


def test_search_order_angle_and_radius(spark):
    L_ = spark.createDataFrame([(1, "E", 1.0, 0.0, [pt(0, 3), pt(10, 3)]), (2, "N", 1.0, 8.0, [pt(0, 1), pt(10, 1)]), (3, "N", 1.0, 179.0, [pt(0, 90), pt(10, 90)])],
                               "seg_id int, dir string, miles double, angle double, points array<struct<x:double,y:double>>").withColumn("c", F.lit(1))
    P_ = spark.createDataFrame([(1, "E", 0.0, 5.0, 0.0), (2, "S", 0.0, 5.0, 0.0), (3, "S", 0.0, 5.0, -9.0), (4, "S", 0.0, 5.0, -18.0), (5, "S", -179.0, 5.0, 90.0), (6, "E", 0.0, 5.0, 8.0)],
                               "link_id int, dir string, angle double, x double, y double").withColumn("c", F.lit(1))
    s = [spatial.Search(5.0, same=("dir",)), spatial.Search(5.0, angle_tolerance=10), spatial.Search(10.0, angle_tolerance=10)]
    got = {r.link_id: (r.seg_id, r.search) for r in spatial.nearest_line(P_, L_, ["c"], s).collect()}
    # same direction wins over nearer; then angle; then the wide radius; 8 degrees at exactly 10 away; no wrap at 180; radius inclusive
    assert got == {1: (1, 1), 2: (2, 2), 3: (2, 3), 6: (1, 1)}


def test_sum_within_concave(spark):
    rng = np.random.default_rng(2)
    zones = {0: [(0, 0), (20, 0), (20, 20), (10, 4), (0, 20)], 1: [(30, 5), (40, 5), (35, 30)], 2: [(90, 90), (95, 90), (95, 95)]}
    pts = [(float(x), float(y), 1.0) for x, y in rng.random((300, 2)) * 50] + [(10.0, 10.0, 5.0)] * 20
    P_ = spark.createDataFrame(pts, "x double, y double, v double")
    Z_ = rings(spark, zones).withColumnRenamed("id", "zone_id")
    for cell in (None, 17.0):
        got = {r.zone_id: r.v for r in spatial.sum_within(P_, Z_, 3.0, ["v"], cell=cell).collect()}
        for z, ring in zones.items():
            closed = list(zip(ring, ring[1:] + ring[:1]))

            def near(x, y):
                odd = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in closed) % 2
                return odd or min(edge_d(x, y, a, b) for a, b in closed) <= 3.0
            assert math.isclose(got[z], sum(v for x, y, v in pts if near(x, y)))


def test_lines(spark):
    df = spark.createDataFrame([("a", 3, 0.0, 3.0), ("a", 1, 0.0, 0.0), ("a", 2, 4.0, 0.0)], "k string, o int, x double, y double")
    r = spatial.points_to_lines(df, ["k"], "o").select(G.line_wkt("points").alias("w"), G.line_length("points").alias("l"), G.ring_area("points").alias("a"),
                                                     G.point_in_ring(F.lit(1.0), F.lit(1.0), "points").alias("i"), G.line_distance(F.lit(4.0), F.lit(-2.0), "points").alias("d"),
                                                     G.ring_distance(F.lit(1.0), F.lit(1.0), "points").alias("z")).first()
    assert r.w == "LINESTRING (0.0 0.0, 4.0 0.0, 0.0 3.0)" and r.l == 9.0 and r.a == 6.0 and r.i and r.d == 2.0 and r.z == 0.0
    m = spark.createDataFrame([("s", i, -121.0 + i / 100, 38.0) for i in range(11)], "k string, o int, lon double, lat double")
    miles = spatial.polyline_miles(m, ["k"], "o").first().length_mi
    assert abs(miles - 5.445) < 0.01


def sheared(ring, off=0.0):
    """A ring under a map that keeps areas times 1.06 and makes upright and level edges slanted."""
    return [(off + x + 0.3 * y, off - 0.2 * x + y) for x, y in ring]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def polygons(spark, shapes):
    return spark.createDataFrame([(i, [[pt(*q) for q in r] for r in rr]) for i, rr in shapes.items()], "id int, rings array<array<struct<x:double,y:double>>>")


@pytest.mark.parametrize("off", [0.0, 2_000_000.0])
def test_overlay_holes_and_parts(spark, off):
    """Exact areas of polygons made of boxes, all of them slanted: a hole, an island in it, a second part, holes of the zone, rings either way round."""
    rng = random.Random(6)
    signed = {0: [(1, (0, 0, 40, 30)), (-1, (5, 5, 25, 25)), (1, (10, 10, 20, 20)), (1, (50, 2, 58, 28))], 1: [(1, (-7, -9, 3, 4))], 2: [(1, (100, 100, 101, 101))],
              3: [(1, (30, 10, 55, 20)), (-1, (35, 12, 36, 13))]}
    zoned = {0: [(1, (-20, -20, 70, 60)), (-1, (2, 2, 15, 12)), (-1, (52, 5, 56, 9))], 1: [(1, (8, 8, 22, 40))], 2: [(1, (40, 0, 50, 30))], 3: [(1, (2, 2, 15, 12))]}

    def shape(spec):
        return [sheared(box(*b)[::rng.choice([1, -1])], off) + ([] if rng.random() < 0.5 else sheared(box(*b), off)[:0]) for _, b in spec]
    p = polygons(spark, {i: shape(s) for i, s in signed.items()}).withColumnsRenamed({"id": "parcelid", "rings": "part_ring"})
    z = polygons(spark, {i: shape(s) for i, s in zoned.items()}).withColumnsRenamed({"id": "zone_id", "rings": "zone_ring"})

    def common(a, b):
        return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    want = {(i, j): 1.06 * sum(s * t * common(a, b) for s, a in pp for t, b in zz) for i, pp in signed.items() for j, zz in zoned.items()}
    want = {k: v for k, v in want.items() if v > 1e-9}
    for cell, crowded in ((3.0, 64), (1000.0, 4), (7.0, 2)):
        got = {(r.parcelid, r.zone_id): r for r in spatial.overlay(p, z, cell, crowded=crowded).collect()}
        assert set(got) == set(want), cell
        assert all(math.isclose(got[k].piece_area, v, rel_tol=1e-7) for k, v in want.items())
        assert all(math.isclose(got[i, j].part_area, 1.06 * sum(s * common(a, a) for s, a in signed[i]), rel_tol=1e-7) for i, j in got)
    # zones that fill the plane between them: the pieces add up to the part, and pieces of a billionth of it are there
    fine = [sheared(box(-30, -30, 20, 70), off), sheared(box(20, -30, 20 + 1e-6, 70), off), sheared(box(20 + 1e-6, -30, 120, 70), off)]
    z = polygons(spark, {i: [r] for i, r in enumerate(fine)}).withColumnsRenamed({"id": "zone_id", "rings": "zone_ring"})
    parts = [r for r in spatial.overlay(p.where("parcelid < 2"), z, 9.0).collect()]
    for i in (0, 1):
        own = [r for r in parts if r.parcelid == i]
        assert math.isclose(sum(r.piece_area for r in own), own[0].part_area, rel_tol=1e-8 if off else 1e-12)
    if not off:
        assert any(0 < r.piece_area < 1e-4 for r in parts) and len(parts) == 4


def test_overlay_strips_grow_with_the_border(spark):
    """A zone's cells of strips: few strips a cell, inner cells one each."""
    from parcelflow.operators import polygons as PG
    z = polygons(spark, {0: [sheared(box(0, 0, 1000, 1000)), sheared(box(200, 200, 300, 300))]})
    s = PG.cell_strips(PG.signed_edges(z, ["id"], "rings"), ["id"], F.lit(10.0)).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.sum("s").alias("s")).toPandas()
    assert s.n.max() <= 6 and (s.n == 1).sum() > 0.9 * len(s)


def test_sum_within_holes_parts_and_runs(spark):
    rng = np.random.default_rng(3)
    shapes = {0: [sheared(box(0, 0, 60, 50)), sheared(box(10, 10, 40, 40)), sheared(box(20, 20, 30, 30)), sheared(box(80, 0, 90, 60))], 1: [sheared(box(-50, -50, 150, 150))],
              2: [sheared(box(300, 300, 301, 301))]}
    pts = [(float(x), float(y), 1.0) for x, y in rng.random((800, 2)) * 140 - 20] + [(15.0, 15.0, 5.0)] * 30
    P_ = spark.createDataFrame(pts, "x double, y double, v double")
    Z_ = polygons(spark, shapes).withColumnsRenamed({"id": "zone_id", "rings": "ring"})
    for cell in (1.0, 2.0, 500.0):
        got = {r.zone_id: r.v for r in spatial.sum_within(P_, Z_, 2.0, ["v"], cell=cell).collect()}
        for z, rr in shapes.items():
            sides = [e for ring in rr for e in zip(ring, ring[1:] + ring[:1])]

            def near(x, y):
                odd = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in sides) % 2
                return odd or min(edge_d(x, y, a, b) for a, b in sides) <= 2.0
            assert math.isclose(got[z], sum(v for x, y, v in pts if near(x, y)), abs_tol=1e-9), (cell, z)


def test_dyadic_blocks(spark):
    from parcelflow.operators.polygons import dyadic_blocks
    rows = [(a, a + n) for a in (-9, -1, 0, 3, 17) for n in (0, 1, 2, 5, 30, 1000)]
    df = spark.createDataFrame(rows, "a long, b long")
    for r in df.withColumn("out", dyadic_blocks(F.col("a"), F.col("b"))).collect():
        cells = sorted(c for k in r.out for c in range(k.at << k.level, (k.at + 1) << k.level))
        assert cells == list(range(r.a, r.b + 1)) and len(r.out) <= 2 * max(1, (r.b - r.a + 1).bit_length())


def test_sum_within_looks_only_along_the_outline(spark):
    """Cells within reach of an edge are whole or crossed by the outline; the crossed ones grow with its length, not with the area."""
    corners = [(0.0, 0.0, 40.0, 20.0), (0.0, 0.0, 0.0, 30.0), (3.0, 4.0, -50.0, 4.0), (5.5, 5.5, 5.5, 5.5), (60.0, 3.0, 5.0, 77.0)]
    edges = spark.createDataFrame([(i, *c) for i, c in enumerate(corners)], "i int, x1 double, y1 double, x2 double, y2 double")
    counts = {}
    for cell in (8.0, 2.0):
        got = {}
        for r in spatial._reach_rows(edges, F.lit(13.0), F.lit(cell)).withColumn("mixed", spatial._mixed()).collect():
            for cx in r.mixed:
                assert got.setdefault((r.i, cx, r.cy), "mixed") == "mixed"
            for cx in range(r.f0, r.f1 + 1) if r.f0 is not None else ():
                assert (r.i, cx, r.cy) not in got
                got[r.i, cx, r.cy] = "whole"
        for i, (x1, y1, x2, y2) in enumerate(corners):
            for cx in range(int(-80 / cell), int(90 / cell)):
                for cy in range(int(-30 / cell), int(100 / cell)):
                    far = [edge_d((cx + a) * cell, (cy + b) * cell, (x1, y1), (x2, y2)) for a in (0, 1) for b in (0, 1)] if (x1, y1) != (x2, y2) else [
                        math.hypot((cx + a) * cell - x1, (cy + b) * cell - y1) for a in (0, 1) for b in (0, 1)]
                    kind = got.get((i, cx, cy))
                    assert (max(far) <= 13.0) or kind != "whole", (i, cx, cy, far)
                    assert min(far) > 13.0 - 1e-9 or kind, (i, cx, cy, far)
        counts[cell] = sum(k == "mixed" for k in got.values())
    assert counts[2.0] < 6 * counts[8.0]
    dense = spark.createDataFrame([(float(i % 100), float(i // 100)) for i in range(10000)], "x double, y double")
    assert spatial._finer(dense, 128.0) <= 8.0 and spatial._finer(dense.where("x < 1 AND y < 1"), 128.0) == 128.0


def test_overlay_slots_list_few_strips_twice(spark):
    """Crowded cells: the strips' places in slots grow as the strips, however many share a cell."""
    for n, mean in ((100, 0.001), (2000, 0.25), (50_000, 0.25), (50_000, 1.0)):
        slots = spark.range(1).select(spatial._slots(F.lit(n), F.lit(n * mean)).alias("s")).first().s
        assert 1 <= slots <= -(-n // 16) and slots * mean <= 4.0
    parts = polygons(spark, {i: [box(i % 40, 0, i % 40 + 20, 10)] for i in range(200)}).withColumnsRenamed({"id": "parcelid", "rings": "part_ring"})
    zones = polygons(spark, {0: [box(5, 2, 45, 8)], 1: [box(30, -5, 90, 5)]}).withColumnsRenamed({"id": "zone_id", "rings": "zone_ring"})
    got = {(r.parcelid, r.zone_id): r.piece_area for r in spatial.overlay(parts, zones, 100.0).collect()}
    for i in range(200):
        for z, (x0, x1, h) in {0: (5, 45, 6.0), 1: (30, 90, 5.0)}.items():
            assert math.isclose(got.get((i, z), 0.0), max(0, min(i % 40 + 20, x1) - max(i % 40, x0)) * h, abs_tol=1e-9)


def test_overlay_pairs_are_added_up_where_they_meet(spark, monkeypatch):
    """Pieces of parts that fit a cell aren't shuffled. Parts of all sizes, one with two rows and one without id, in windows dealt out to many tasks."""
    monkeypatch.setattr(spatial, "TASK_ROWS", 512)
    rng = random.Random(3)
    side = lambda i: 45 if i % 10 == 0 else rng.choice([1, 2, 5])
    boxes = [(i, rng.randrange(0, 60), rng.randrange(0, 60), side(i), side(i)) for i in range(60)] + [(7, 11, 12, 2, 3), (None, 30, 30, 4, 4)]
    boxes = [(i, x, y, x + w, y + h) for i, x, y, w, h in boxes]
    zoned = {j: (rng.randrange(-5, 50), rng.randrange(-5, 50), 20 + j % 7, 25) for j in range(30)}
    zoned = {j: (x, y, x + w, y + h) for j, (x, y, w, h) in zoned.items()}
    shape = "array<struct<x:double,y:double>>"
    p = spark.createDataFrame([(i, [pt(*q) for q in box(*b)], 2.0) for i, *b in boxes], f"parcelid int, part_ring {shape}, worth double")
    z = spark.createDataFrame([(j, [pt(*q) for q in box(*b)]) for j, b in zoned.items()], f"zone_id int, zone_ring {shape}")
    want = {}
    for i, *a in boxes:
        for j, b in zoned.items():
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if w > 0 and h > 0:
                want[i, j] = want.get((i, j), 0) + w * h
    out = spatial.overlay(p, z, 20.0, carry=["worth"]).collect()
    assert {(r.parcelid, r.zone_id): r.piece_area for r in out} == pytest.approx(want) and {r.worth for r in out} == {2.0}
    alone = spatial.overlay(p.where("parcelid % 10 <> 0"), z, 20.0)._jdf.queryExecution().executedPlan().toString()
    above, _, below = alone.partition("SortMergeJoin")
    assert "HashAggregate" in above and "Exchange" not in above and "Exchange" in below
