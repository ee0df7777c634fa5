"""Free-flow, period and congested speeds per road segment from probe epochs.

``epochs``: tmc_code, measurement_tstamp, speed, travel_time_seconds. ``segments``: tmc, f_system, miles and
descriptive columns. Every plan reads the epochs with the columns and rows it needs and reduces them per
segment with map-side combined aggregates before joining the segment table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators.aggregates import congested_mile_share, harmonic_mean
from parcelflow.operators.percentiles import grouped_percentiles
from parcelflow.session import materialize

OVERNIGHT = (20, 6)
LATE_NIGHT = (22, 4)


def free_flow_by_class(epochs: DataFrame, hours: tuple[int, int] = OVERNIGHT) -> DataFrame:
    """Per segment, the freeway and the arterial percentile of overnight speeds."""
    night = epochs.where(S.hour_window("measurement_tstamp", *hours))
    return grouped_percentiles(night, ["tmc_code"], "speed", {
        "p_freeway": (K.FREEWAY_PERCENTILE, "cont"), "p_arterial": (K.ARTERIAL_PERCENTILE, "cont")})


def by_class(f_system="f_system") -> Column:
    return F.when(F.col(f_system).isin(K.FREEWAY_SYSTEMS), F.col("p_freeway")).otherwise(F.col("p_arterial"))


def free_flow_speeds(segments: DataFrame, epochs: DataFrame, other_segments: DataFrame, years=("geo", "spd")) -> DataFrame:
    """Free-flow speed by class, plain 85th percentile, late-night harmonic mean, and lengths of two vintages."""
    pct = free_flow_by_class(epochs)
    night = (epochs.where(S.hour_window("measurement_tstamp", *LATE_NIGHT)).groupBy("tmc_code")
             .agg(harmonic_mean("speed").alias("avspd_10p4a"), F.count(F.lit(1)).alias("epoch_cnt10p4a")))
    other = other_segments.select("tmc", F.col("miles").alias(f"len_mi{years[1]}"))
    code = lambda df: df.withColumnRenamed("tmc_code", "tmc")
    out = segments.join(other, "tmc", "left").join(code(pct), "tmc", "left").join(code(night), "tmc", "left")
    return out.select("tmc", "road", "f_system", F.col("miles").alias(f"len_mi{years[0]}"), f"len_mi{years[1]}",
                      by_class().alias("ffs_85th60th"), F.col("p_freeway").alias("ffs_85"), "avspd_10p4a", "epoch_cnt10p4a")


def period_speed_stats(segments: DataFrame, epochs: DataFrame, periods: dict[str, list[int]] | None = None,
                       months=K.SURVEY_MONTHS, days=K.SURVEY_DAYS, slim: bool = False) -> DataFrame:
    """Harmonic mean, epoch count, standard deviation and relative error per segment and period, wide.

    One scan of the epochs serves all periods. A segment without epochs in a period has NULL speeds and 0 epochs.
    """
    periods = periods or K.MODEL_PERIODS
    picked = epochs.where(S.month_filter("measurement_tstamp", months) & S.weekday_filter("measurement_tstamp", days))
    picked = picked.select("tmc_code", "speed", S.hour_period(F.hour("measurement_tstamp"), periods).alias("prd"))
    stats = (picked.where(F.col("prd").isNotNull()).groupBy("tmc_code", "prd")
             .agg(harmonic_mean("speed").alias("avspd"), F.count(F.lit(1)).alias("epcnt"),
                  F.stddev_samp("speed").alias("stdev")))
    wide = stats.groupBy("tmc_code").agg(*[
        F.max(F.when(F.col("prd") == p, F.col(c))).alias(f"{c}_{p}") for p in periods for c in ("avspd", "epcnt", "stdev")])
    out = segments.select("tmc").join(wide.withColumnRenamed("tmc_code", "tmc"), "tmc", "left")
    cols = ["tmc"]
    for p in periods:
        if slim:
            cols.append(f"avspd_{p}")
            continue
        cols += [f"avspd_{p}", F.coalesce(F.col(f"epcnt_{p}"), F.lit(0)).alias(f"epcnt_{p}"), f"stdev_{p}",
                 F.try_divide(f"stdev_{p}", f"avspd_{p}").alias(f"spd_stderr_{p}")]
    return out.select(*cols)


def period_percentile_bands(segments: DataFrame, epochs: DataFrame, period: str, hours: list[int],
                            months=K.SURVEY_MONTHS, days=K.SURVEY_DAYS) -> DataFrame:
    """Discrete 25th and 75th percentile speeds of one period."""
    picked = epochs.where(S.month_filter("measurement_tstamp", months) & S.weekday_filter("measurement_tstamp", days)
                          & F.hour("measurement_tstamp").isin(hours))
    pct = grouped_percentiles(picked, ["tmc_code"], "speed", {
        f"pctlspd25_{period}": (0.25, "disc"), f"pctlspd75_{period}": (0.75, "disc")})
    return segments.select("tmc").join(pct.withColumnRenamed("tmc_code", "tmc"), "tmc", "left")


def hourly_speeds(epochs: DataFrame, days=K.WORKING_DAYS) -> DataFrame:
    """Per segment and hour: additive parts over working days (epochs, reciprocal speeds, travel time) and epochs of all days."""
    working = S.weekday_filter("measurement_tstamp", days)
    return epochs.groupBy("tmc_code", F.hour("measurement_tstamp").alias("hour_of_day")).agg(
        F.count(F.when(working, 1)).alias("n"), F.sum(F.when(working, F.try_divide(F.lit(1.0), F.col("speed")))).alias("recip"),
        F.avg(F.when(working, F.col("travel_time_seconds"))).alias("avg_tt_sec"), F.count(F.lit(1)).alias("n_all_days"))


def _rank_hours(segments: DataFrame, hours: DataFrame, pct: DataFrame, min_epochs: int) -> DataFrame:
    ff = segments.select(F.col("tmc").alias("tmc_code"), "f_system").join(pct, "tmc_code")
    ff = ff.select("tmc_code", by_class().alias("ff_speed"))
    h = hours.where(F.col("n") >= min_epochs).join(ff, "tmc_code").withColumn("havg_spd", F.try_divide("n", "recip"))
    h = h.withColumn("cong_ratio", F.try_divide("havg_spd", "ff_speed")).drop("n_all_days")
    # at most 24 rows per segment
    return h.withColumn("hour_rank", F.rank().over(Window.partitionBy("tmc_code").orderBy("cong_ratio")))


def ranked_hours(segments: DataFrame, epochs: DataFrame, min_epochs: int = 100) -> DataFrame:
    """Working-day hours of each segment ranked by speed relative to free flow; ties share a rank, thin hours are dropped."""
    return _rank_hours(segments, hourly_speeds(epochs), free_flow_by_class(epochs), max(min_epochs, 1))


def congestion_intensity(segments: DataFrame, epochs: DataFrame, min_epochs: int = 100, worst: int = 4) -> DataFrame:
    """Free-flow speed, speed in the worst hours and the slowest hour per segment; -1 where unknown.

    The epochs are read for the percentiles and once more for everything else: the worst-hours speed adds up
    hourly counts and reciprocal sums. Both per-segment results are written once and used twice. Of several
    equally slow hours the earliest is shown.
    """
    pct = materialize(free_flow_by_class(epochs), "free-flow")
    hours = materialize(hourly_speeds(epochs), "hourly-speeds")
    h = _rank_hours(segments, hours, pct, max(min_epochs, 1)).where(F.col("hour_rank") <= worst)
    first = F.col("hour_rank") == 1
    slow = F.struct(F.col("havg_spd").alias("spd"), F.col("hour_of_day").alias("hr"), F.col("n").alias("n"))
    per = h.groupBy("tmc_code").agg(
        F.sum("n").alias("epochs_worst4hrs"), F.try_divide(F.sum("n"), F.sum("recip")).alias("havg_spd_worst4hrs"),
        F.min(F.when(first, slow)).alias("slow")).select(
        F.col("tmc_code").alias("tmc"), "epochs_worst4hrs", "havg_spd_worst4hrs",
        F.col("slow.hr").alias("slowest_hr"), F.col("slow.spd").alias("slowest_hr_speed"), F.col("slow.n").alias("epochs_slowest_hr"))
    start, end = OVERNIGHT
    dark = (F.col("hour_of_day") >= start) | (F.col("hour_of_day") < end)
    night = hours.where(dark).groupBy(F.col("tmc_code").alias("tmc")).agg(F.sum("n_all_days").alias("epochs_night"))
    out = segments.join(pct.withColumnRenamed("tmc_code", "tmc"), "tmc", "left").join(per, "tmc", "left").join(night, "tmc", "left")
    out = out.withColumn("ff", by_class())
    worst_ratio, slow_ratio = F.try_divide("havg_spd_worst4hrs", "ff"), F.try_divide("slowest_hr_speed", "ff")
    or_minus = lambda c: F.coalesce(c, F.lit(-1))
    return out.select(
        "tmc", "road", "route_numb", "cmp_tag", "f_system", "nhs", "miles",
        or_minus(F.col("ff")).alias("ff_speed_art60thp"), or_minus(F.col("havg_spd_worst4hrs")).alias("havg_spd_worst4hrs"),
        F.when(worst_ratio.isNull(), F.lit(-1.0)).when(worst_ratio > 1, F.lit(1.0)).otherwise(worst_ratio).alias("congratio_worst4hrs"),
        or_minus(F.col("slowest_hr")).alias("slowest_hr"), or_minus(F.col("slowest_hr_speed")).alias("slowest_hr_speed"),
        or_minus(slow_ratio).alias("congratio_worsthr"), or_minus(F.col("epochs_worst4hrs")).alias("epochs_worst4hrs"),
        or_minus(F.col("epochs_slowest_hr")).alias("epochs_slowest_hr"), or_minus(F.col("epochs_night")).alias("epochs_night"))


def congested_miles(intensity: DataFrame) -> DataFrame:
    """Share of directional miles congested in the worst hours, interstate and other, tagged segments only."""
    name = F.when(F.col("f_system") == 1, "Interstate CMP").otherwise("Non-Interstate CMP")
    return congested_mile_share(intensity.where("cmp_tag = 1"), name, "FSystem", "congratio_worst4hrs", "miles")


def congested_hours(segments: DataFrame, epochs: DataFrame, ratio: float = K.CONGESTED_RATIO) -> DataFrame:
    """Average daily congested hours and hours with data per segment, working days; -1 where unknown."""
    ff = (segments.select(F.col("tmc").alias("tmc_code"), "f_system").join(free_flow_by_class(epochs), "tmc_code")
          .select("tmc_code", by_class().alias("ff")))
    ff = materialize(ff, "free-flow")  # used twice, and small beside the epochs: these needn't be shuffled to meet it
    picked = epochs.where(S.weekday_filter("measurement_tstamp", K.WORKING_DAYS)).select(
        "tmc_code", "speed", F.dayofyear("measurement_tstamp").alias("doy")).join(ff, "tmc_code", "left")
    slow = F.try_divide("speed", "ff") <= ratio
    days = picked.groupBy("tmc_code", "doy").agg(
        F.sum(F.when(slow, F.lit(K.EPOCH_HOURS)).otherwise(F.lit(0.0))).alias("cong"),
        (F.count(F.lit(1)) * K.EPOCH_HOURS).alias("hours"))
    per = days.groupBy("tmc_code").agg(F.avg("cong").alias("cong"), F.min("hours").alias("least"), F.avg("hours").alias("mean"))
    out = (segments.select("tmc", "road", "direction").join(per.withColumnRenamed("tmc_code", "tmc"), "tmc", "left")
           .join(ff.withColumnRenamed("tmc_code", "tmc"), "tmc", "left"))
    or_minus = lambda c: F.coalesce(F.col(c), F.lit(-1.0))
    return out.select("tmc", "road", "direction", or_minus("ff").alias("ff_speed_85th60th"),
                      or_minus("cong").alias("avg_daily_conghrs"), or_minus("least").alias("min_day_hrs_w_data"),
                      or_minus("mean").alias("avg_daily_hrs_w_data"))


def compare_free_flow_methods(segments: DataFrame, epochs: DataFrame, early=(3, 6)) -> DataFrame:
    """85th percentile overnight beside the harmonic mean of the early hours."""
    night = epochs.where(S.hour_window("measurement_tstamp", *OVERNIGHT))
    pct = grouped_percentiles(night, ["tmc_code"], "speed", {"ffs_85": (K.FREEWAY_PERCENTILE, "cont")})
    mean = (epochs.where(S.hour_window("measurement_tstamp", *early)).groupBy("tmc_code")
            .agg(F.count(F.lit(1)).alias("epochs_early"), harmonic_mean("speed").alias("havgspd_early")))
    code = lambda df: df.withColumnRenamed("tmc_code", "tmc")
    return segments.select("tmc", "f_system").join(code(pct), "tmc", "left").join(code(mean), "tmc", "left")
