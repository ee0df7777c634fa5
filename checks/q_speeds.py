"""Speed study and its checks."""

from pyspark.sql import functions as F

from checks.domain import table, view, with_views
from checks.registry import query, r
from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators import aggregates as A
from parcelflow.operators import joins as J
from parcelflow.operators import percentiles as P
from parcelflow.operators import windows as W
from parcelflow.plans import speeds as V

HARM = "count(*) / sum(1.0 / nullif(speed, 0))"
NIGHT = "(hour(measurement_tstamp) >= 20 OR hour(measurement_tstamp) < 6)"
FF = f"""ff AS (SELECT tmc_code, quantile_cont(speed, 0.85) AS p85, quantile_cont(speed, 0.6) AS p60 FROM epochs WHERE {NIGHT} GROUP BY tmc_code)"""
CLS = "CASE WHEN s.f_system IN (1, 2) THEN f.p85 ELSE f.p60 END"
WORKDAY = "dayofweek(measurement_tstamp) BETWEEN 1 AND 5"
STUDY = "month(measurement_tstamp) = 1 AND dayofweek(measurement_tstamp) BETWEEN 2 AND 4"
MONTHS = [1]


@query("free_flow_speeds", with_views(f"""WITH {FF}, n AS (SELECT tmc_code, {HARM} AS av, count(*) AS c FROM epochs
     WHERE hour(measurement_tstamp) >= 22 OR hour(measurement_tstamp) < 4 GROUP BY tmc_code)
   SELECT s.tmc, s.road, s.f_system, {r('s.miles')} AS len_migeo, {r('o.miles')} AS len_mispd, {r(CLS)} AS ffs_85th60th, {r('f.p85')} AS ffs_85,
     {r('n.av')} AS avspd_10p4a, n.c AS epoch_cnt10p4a
   FROM segments s LEFT JOIN segments_new o ON o.tmc = s.tmc LEFT JOIN ff f ON f.tmc_code = s.tmc LEFT JOIN n ON n.tmc_code = s.tmc""",
   "segments", "segments_new", "epochs"))
def _ff(spark, sf):
    return V.free_flow_speeds(view(spark, sf, "segments"), view(spark, sf, "epochs"), view(spark, sf, "segments_new"))


def _period_sql(slim=False):
    cols, joins = [], []
    for p, hrs in K.MODEL_PERIODS.items():
        joins.append(f"""LEFT JOIN (SELECT tmc_code, {HARM} AS av, count(*) AS c, stddev_samp(speed) AS sd FROM epochs
            WHERE {STUDY} AND hour(measurement_tstamp) IN ({', '.join(map(str, hrs))}) GROUP BY tmc_code) {p} ON {p}.tmc_code = s.tmc""")
        cols.append(f"{r(f'{p}.av')} AS avspd_{p}")
        if not slim:
            cols.append(f"coalesce({p}.c, 0) AS epcnt_{p}, {r(f'{p}.sd')} AS stdev_{p}, {r(f'{p}.sd / {p}.av')} AS spd_stderr_{p}")
    return f"SELECT s.tmc, {', '.join(cols)} FROM segments s {' '.join(joins)}"


for _slim in (False, True):
    @query("period_speeds_slim" if _slim else "period_speeds", with_views(_period_sql(_slim), "segments", "epochs"))
    def _periods(spark, sf, slim=_slim):
        return V.period_speed_stats(view(spark, sf, "segments"), view(spark, sf, "epochs"), months=MONTHS, slim=slim)


FRAMES = {n: f"(SELECT tmc_code, {HARM} AS v FROM epochs WHERE hour(measurement_tstamp) IN ({', '.join(map(str, h))}) GROUP BY 1)" for n, h in K.MODEL_PERIODS.items()}


@query("merge_periods", with_views(f"""SELECT tmc_code, {', '.join(f"{r(f'{n}.v')} AS v_{n}" for n in FRAMES)} FROM
   {' JOIN '.join(f'{q} {n}' + (' USING (tmc_code)' if i else '') for i, (n, q) in enumerate(FRAMES.items()))}""", "epochs"))
def _merge(spark, sf):
    e = view(spark, sf, "epochs")
    one = lambda n, h: e.where(F.hour("measurement_tstamp").isin(h)).groupBy("tmc_code").agg(A.harmonic_mean("speed").alias(f"v_{n}"))
    return J.merge_on_key([one(n, h) for n, h in K.MODEL_PERIODS.items()], "tmc_code")


@query("period_percentile_bands", with_views(f"""SELECT s.tmc, {r('p.a')} AS pctlspd25_n11, {r('p.b')} AS pctlspd75_n11 FROM segments s LEFT JOIN
   (SELECT tmc_code, quantile_disc(speed, 0.25) AS a, quantile_disc(speed, 0.75) AS b FROM epochs
    WHERE {STUDY} AND hour(measurement_tstamp) IN (20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6) GROUP BY 1) p ON p.tmc_code = s.tmc""", "segments", "epochs"))
def _bands(spark, sf):
    return V.period_percentile_bands(view(spark, sf, "segments"), view(spark, sf, "epochs"), "n11", K.MODEL_PERIODS["n11"], months=MONTHS)


MIN_EPOCHS = 2
HOURS = f"""hrs AS (SELECT e.tmc_code, hour(measurement_tstamp) AS hr, count(*) AS n, sum(1.0 / nullif(speed, 0)) AS rc, avg(travel_time_seconds) AS tt
     FROM epochs e WHERE {WORKDAY} GROUP BY 1, 2 HAVING count(*) >= {MIN_EPOCHS}),
   rk AS (SELECT h.*, {CLS} AS ff, h.n / h.rc AS sp, h.n / h.rc / {CLS} AS ratio, rank() OVER (PARTITION BY h.tmc_code ORDER BY h.n / h.rc / {CLS}) AS k
     FROM hrs h JOIN segments s ON s.tmc = h.tmc_code JOIN ff f ON f.tmc_code = h.tmc_code)"""


@query("ranked_hours", with_views(f"""WITH {FF}, {HOURS} SELECT tmc_code, hr AS hour_of_day, n, {r('tt')} AS avg_tt_sec, {r('sp')} AS havg_spd, {r('ratio')} AS cong_ratio,
   k AS hour_rank FROM rk""", "segments", "epochs"))
def _ranked(spark, sf):
    h = V.ranked_hours(view(spark, sf, "segments"), view(spark, sf, "epochs"), MIN_EPOCHS)
    return h.select("tmc_code", F.col("hour_of_day").cast("bigint").alias("hour_of_day"), "n", "avg_tt_sec", "havg_spd", "cong_ratio",
                    F.col("hour_rank").cast("bigint").alias("hour_rank"))


INTENSITY = f"""WITH {FF}, {HOURS},
   w AS (SELECT tmc_code, sum(n)::BIGINT AS n, sum(n) / sum(rc) AS sp FROM rk WHERE k < 5 GROUP BY 1),
   sl AS (SELECT tmc_code, hr, sp, n FROM (SELECT *, row_number() OVER (PARTITION BY tmc_code ORDER BY sp, hr) AS i FROM rk WHERE k = 1) q WHERE i = 1),
   nt AS (SELECT tmc_code, count(*) AS n FROM epochs WHERE {NIGHT} GROUP BY 1),
   fin AS (SELECT s.tmc, s.road, s.route_numb, s.cmp_tag, s.f_system, s.nhs, s.miles, coalesce({CLS}, -1) AS ff, coalesce(w.sp, -1) AS wsp,
      CASE WHEN w.sp / ({CLS}) IS NULL THEN -1 ELSE least(1, w.sp / ({CLS})) END AS wr, coalesce(sl.hr, -1) AS shr, coalesce(sl.sp, -1) AS ssp,
      coalesce(sl.sp / ({CLS}), -1) AS sr, coalesce(w.n, -1) AS wn, coalesce(sl.n, -1) AS sn, coalesce(nt.n, -1) AS nn
    FROM segments s LEFT JOIN ff f ON f.tmc_code = s.tmc LEFT JOIN w ON w.tmc_code = s.tmc LEFT JOIN sl ON sl.tmc_code = s.tmc LEFT JOIN nt ON nt.tmc_code = s.tmc)"""


@query("congestion_intensity", with_views(f"""{INTENSITY} SELECT tmc, road, route_numb, cmp_tag, f_system, nhs, {r('miles')} AS miles, {r('ff')} AS ff_speed_art60thp,
   {r('wsp')} AS havg_spd_worst4hrs, {r('wr')} AS congratio_worst4hrs, CAST(shr AS INT) AS slowest_hr, {r('ssp')} AS slowest_hr_speed, {r('sr')} AS congratio_worsthr,
   wn AS epochs_worst4hrs, sn AS epochs_slowest_hr, nn AS epochs_night FROM fin""", "segments", "epochs"))
def _intensity(spark, sf):
    return V.congestion_intensity(view(spark, sf, "segments"), view(spark, sf, "epochs"), MIN_EPOCHS)


@query("congested_miles", with_views(f"""{INTENSITY} SELECT CASE WHEN f_system = 1 THEN 'Interstate CMP' ELSE 'Non-Interstate CMP' END AS FSystem,
   {r('sum(CASE WHEN wr > 0 AND wr < 0.6 THEN miles ELSE 0 END)')} AS cong_dirmiles, {r('sum(CASE WHEN wr > 0 THEN miles ELSE 0 END)')} AS tot_dirmiles,
   {r('sum(CASE WHEN wr > 0 AND wr < 0.6 THEN miles ELSE 0 END) / sum(CASE WHEN wr > 0 THEN miles ELSE 0 END)')} AS pct_cong_dirmiles
   FROM fin WHERE cmp_tag = 1 GROUP BY 1""", "segments", "epochs"))
def _cong_miles(spark, sf):
    return V.congested_miles(V.congestion_intensity(view(spark, sf, "segments"), view(spark, sf, "epochs"), MIN_EPOCHS))


@query("congested_hours", with_views(f"""WITH {FF}, fs AS (SELECT s.tmc, {CLS} AS ff FROM segments s JOIN ff f ON f.tmc_code = s.tmc),
   d AS (SELECT e.tmc_code, dayofyear(measurement_tstamp) AS doy, sum(CASE WHEN speed / ff <= 0.6 THEN 0.25 ELSE 0 END) AS c, count(*) * 0.25 AS h
         FROM epochs e LEFT JOIN fs ON fs.tmc = e.tmc_code WHERE {WORKDAY} GROUP BY 1, 2)
   SELECT s.tmc, s.road, s.direction, {r('coalesce(max(fs.ff), -1)')} AS ff_speed_85th60th, {r('coalesce(avg(d.c), -1)')} AS avg_daily_conghrs,
     {r('coalesce(min(d.h), -1)')} AS min_day_hrs_w_data, {r('coalesce(avg(d.h), -1)')} AS avg_daily_hrs_w_data
   FROM segments s LEFT JOIN d ON d.tmc_code = s.tmc LEFT JOIN fs ON fs.tmc = s.tmc GROUP BY 1, 2, 3""", "segments", "epochs"))
def _cong_hours(spark, sf):
    return V.congested_hours(view(spark, sf, "segments"), view(spark, sf, "epochs"))


@query("compare_free_flow_methods", with_views(f"""SELECT s.tmc, s.f_system, {r('a.p')} AS ffs_85, b.c AS epochs_early, {r('b.h')} AS havgspd_early FROM segments s
   LEFT JOIN (SELECT tmc_code, quantile_cont(speed, 0.85) AS p FROM epochs WHERE {NIGHT} GROUP BY 1) a ON a.tmc_code = s.tmc
   LEFT JOIN (SELECT tmc_code, count(*) AS c, {HARM} AS h FROM epochs WHERE hour(measurement_tstamp) >= 3 AND hour(measurement_tstamp) < 6 GROUP BY 1) b ON b.tmc_code = s.tmc""",
   "segments", "epochs"))
def _methods(spark, sf):
    return V.compare_free_flow_methods(view(spark, sf, "segments"), view(spark, sf, "epochs"))


@query("segment_vintage_diff", with_views(f"""SELECT a.tmc AS tmc_y1, b.tmc AS tmc_y2, {r('a.miles')} AS miles_y1, {r('b.miles')} AS miles_y2,
   {r('b.miles - a.miles')} AS lenchg_y1_y2 FROM segments a FULL JOIN segments_new b ON a.tmc = b.tmc""", "segments", "segments_new"))
def _vintage(spark, sf):
    return J.compare_vintages(view(spark, sf, "segments"), view(spark, sf, "segments_new"), "tmc", "miles", change="lenchg_y1_y2")


@query("percentiles_hot_groups", f"""SELECT l_returnflag, {r('quantile_cont(l_extendedprice, 0.85)')} AS p85, {r('quantile_cont(l_extendedprice, 0.5)')} AS p50,
   {r('quantile_disc(l_extendedprice, 0.25)')} AS d25, {r('quantile_cont(l_extendedprice, 0)')} AS p0, {r('quantile_cont(l_extendedprice, 1)')} AS p100 FROM lineitem GROUP BY 1""")
def _hot(spark, sf):
    return P.grouped_percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", {
        "p85": (0.85, "cont"), "p50": (0.5, "cont"), "d25": (0.25, "disc"), "p0": (0.0, "cont"), "p100": (1.0, "cont")})


@query("percentile_over", f"""SELECT o_orderkey, {r('quantile_cont(o_totalprice, 0.85) OVER (PARTITION BY o_orderpriority)')} AS p85 FROM orders""")
def _over(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return P.percentile_over(o, ["o_orderpriority"], "o_totalprice", "p85", 0.85).select("o_orderkey", "p85")


@query("percentiles_negative_values", f"SELECT c_nationkey, {r('quantile_cont(c_acctbal, 0.1)')} AS p10, {r('quantile_disc(c_acctbal, 0.6)')} AS d60 FROM customer GROUP BY 1")
def _neg(spark, sf):
    return P.grouped_percentiles(table(spark, sf, "customer"), ["c_nationkey"], "c_acctbal", {"p10": (0.1, "cont"), "d60": (0.6, "disc")})


@query("cumulative_stddev", f"""SELECT DISTINCT user_id, count(*) OVER (PARTITION BY user_id) AS cnt, {r('avg(value) OVER (PARTITION BY user_id)')} AS avg,
   {r('stddev_samp(value) OVER (ORDER BY user_id)')} AS std_dev FROM events""")
def _cumsd(spark, sf):
    return W.cumulative_stddev(table(spark, sf, "events"), "user_id", "value", "std_dev")


@query("cumulative_stddev_far_from_zero", f"""WITH e AS (SELECT event_type, user_id, value + 1e9 AS v FROM events)
   SELECT DISTINCT event_type, user_id, count(*) OVER (PARTITION BY event_type, user_id) AS cnt,
   {r('round(stddev_samp(v - 1e9) OVER (PARTITION BY event_type ORDER BY user_id), 3)')} AS std_dev FROM e""")
def _cumsd_far(spark, sf):
    e = table(spark, sf, "events").select("event_type", "user_id", (F.col("value") + 1e9).alias("v"))
    out = W.cumulative_stddev(e, "user_id", "v", "std_dev", ["event_type"], chunk=20)
    return out.drop("avg").withColumn("std_dev", F.round("std_dev", 3))


@query("harmonic_mean", f"SELECT event_type, {r('count(*) / sum(1.0 / nullif(value, 0))')} AS h FROM events GROUP BY 1")
def _harm(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(A.harmonic_mean("value").alias("h"))


@query("date_parts", """SELECT event_id, CAST(hour(ts) AS INT) AS hour, dayname(ts) AS day_name, CAST(dayofweek(ts) + 1 AS INT) AS dow,
   CAST(dayofyear(ts) AS INT) AS doy, CAST(month(ts) AS INT) AS month FROM events""")
def _dates(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in S.date_parts("ts").items()])


@query("hour_and_day_filters", """SELECT 'night' AS which, count(*) AS n FROM events WHERE hour(ts) >= 22 OR hour(ts) < 4
   UNION ALL SELECT 'midday', count(*) FROM events WHERE hour(ts) >= 10 AND hour(ts) < 14
   UNION ALL SELECT 'midweek', count(*) FROM events WHERE dayname(ts) IN ('Tuesday', 'Wednesday', 'Thursday')
   UNION ALL SELECT 'january', count(*) FROM events WHERE month(ts) IN (1, 3)""")
def _filters(spark, sf):
    e = table(spark, sf, "events")
    preds = {"night": S.hour_window("ts", 22, 4), "midday": S.hour_window("ts", 10, 14), "midweek": S.weekday_filter("ts", K.SURVEY_DAYS),
             "january": S.month_filter("ts", [1, 3])}
    return A.cond_counts(e, [], preds).unpivot([], list(preds), "which", "n")


@query("having_at_least", f"SELECT user_id, {r('avg(value)')} AS av FROM events GROUP BY 1 HAVING count(*) >= 66")
def _having(spark, sf):
    return A.having_at_least(table(spark, sf, "events"), ["user_id"], 66, [F.avg("value").alias("av")])


@query("two_level_average", f"""SELECT user_id, {r('avg(s)')} AS mean_daily, {r('min(s)')} AS least_daily FROM
   (SELECT user_id, dayofyear(ts) AS d, sum(value / 7.3) AS s FROM events GROUP BY 1, 2) q GROUP BY 1""")
def _two(spark, sf):
    e = table(spark, sf, "events").withColumn("d", F.dayofyear("ts"))
    return A.two_level(e, ["user_id", "d"], [F.sum(F.col("value") / 7.3).alias("s")], ["user_id"], [F.avg("s").alias("mean_daily"), F.min("s").alias("least_daily")])
