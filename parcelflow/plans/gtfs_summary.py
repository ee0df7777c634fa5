"""Route service by period from GTFS feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators.spatial import polyline_miles
from parcelflow.session import materialize


def trip_times(stop_times: DataFrame) -> DataFrame:
    """One row per trip: stops, first-stop departure, last departure, earliest period.

    Stop times are by far the largest feed table; they are reduced to trips before any join.
    """
    dep = S.minutes_after_midnight("departure_time")
    st = stop_times.select("agency", "trip_id", "stop_id", "stop_sequence", dep.alias("dep"))
    return st.withColumn("prd", S.period_of("dep")).groupBy("agency", "trip_id").agg(
        F.count("stop_id").alias("n_stops"), F.min(F.when(F.col("stop_sequence") == 1, F.col("dep"))).alias("dep1"),
        F.max("dep").alias("last_dep"), F.min("prd").alias("first_prd"))


def weekday_trips(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trips of weekday services with route name, stop count, times and whether they are full runs."""
    service = calendar.where(S.weekday_service()).select("agency", "service_id").distinct()
    t = (trips.select("agency", "route_id", "trip_id", "direction_id", "service_id", "shape_id")
         .join(service, ["agency", "service_id"], "left_semi")
         .join(routes.select("agency", "agency_id", "route_id", "route_long_name"), ["agency", "route_id"])
         .join(trip_times(stop_times), ["agency", "trip_id"], "left"))
    name = F.concat(F.col("agency"), F.col("route_id").cast("string"), F.lit("_"), S.direction_tag("direction_id"))
    # trips are read several times below; stop times must not be reduced to them again
    t = materialize(t.withColumns({"uniq_rte_name": name, "n_stops": F.coalesce("n_stops", F.lit(0))}), "gtfs-trips")
    longest = t.groupBy("uniq_rte_name").agg(F.max("n_stops").alias("max_stops"))
    return t.join(longest, "uniq_rte_name")


def model_hour_trips(trips: DataFrame) -> DataFrame:
    """Trips that start in periods 1 to 5, by first departure not before the earliest start."""
    start = F.when(F.col("dep1") < K.GTFS_EARLIEST_START, F.lit(K.GTFS_NO_PERIOD)).otherwise(F.coalesce("first_prd", F.lit(K.GTFS_NO_PERIOD)))
    return trips.withColumn("start_prd", start).where(F.col("start_prd") < max(K.GTFS_PERIODS))


def gtfs_line_summary(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, calendar: DataFrame,
                      shapes: DataFrame, old_names: DataFrame | None = None) -> DataFrame:
    """Per route and direction, for periods 1 to 5: trips, first two departures, headways, vehicle hours and miles, speed."""
    t = model_hour_trips(weekday_trips(routes, trips, stop_times, calendar))
    length = polyline_miles(shapes, ["agency", "shape_id"], "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat", "trip_len_mi")
    t = t.join(length, ["agency", "shape_id"], "left")
    t = t.withColumns({"prd": S.period_of("dep1"), "duration": F.col("last_dep") - F.col("dep1"),
                       "full": F.col("n_stops") == F.col("max_stops")})
    last = max(K.GTFS_PERIODS)
    names = t.groupBy("uniq_rte_name", "agency_id", "route_long_name").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    # trips by minute of departure: at most one row per minute of a period, so later steps stay small for any route
    minute = t.where(F.col("dep1").isNotNull() & (F.col("prd") < last)).groupBy("uniq_rte_name", "prd", "dep1").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("dur"), F.count("duration").alias("n_dur"),
        F.sum(F.when(F.col("full"), F.col("duration"))).alias("full_dur"),
        F.count(F.when(F.col("full"), F.col("duration"))).alias("n_full"), F.sum("trip_len_mi").alias("mi"))
    per = minute.groupBy("uniq_rte_name", "prd").agg(
        F.sum("n").alias("tripcnt"), F.min("dep1").alias("first_dep"),
        F.min(F.struct("dep1", "n")).getField("n").alias("at_first"), F.sort_array(F.collect_list("dep1")).alias("minutes"),
        (F.sum("dur") / 60).alias("vsh"), F.coalesce(F.sum("mi"), F.lit(0.0)).alias("vsm"),
        F.coalesce(F.try_divide(F.sum("full_dur"), F.sum("n_full")), F.try_divide(F.sum("dur"), F.sum("n_dur"))).alias("avg_trpdur"))
    second = F.when(F.col("at_first") > 1, F.col("first_dep")).otherwise(F.get("minutes", F.lit(1)))
    span = S.first_match([(F.col("prd") == k, F.lit(b - a)) for k, (a, b) in K.GTFS_PERIODS.items()])
    per = per.withColumn("second_dep", second).withColumns({
        "avgheadway": F.try_divide(span, F.col("tripcnt")), "iheadway": F.col("second_dep") - F.col("first_dep"),
        "avg_speed": F.try_divide("vsm", "vsh")})
    shown = {"tripcnt": "tripcnt_", "first_dep": "first_dep", "second_dep": "second_dep", "avgheadway": "avgheadway_",
             "iheadway": "iheadway_", "vsh": "vsh_", "avg_trpdur": "avg_trpdur", "avg_speed": "avg_speed", "vsm": "vsm"}
    wide = per.groupBy("uniq_rte_name").agg(*[
        F.max(F.when(F.col("prd") == k, F.col(c))).alias(f"{n}{k}") for k in K.GTFS_PERIODS if k != last for c, n in shown.items()])
    out = names.join(wide, "uniq_rte_name", "left")
    return out if old_names is None else out.join(old_names, "uniq_rte_name", "left")


def service_span(trips: DataFrame) -> DataFrame:
    """Latest departure, earliest departure and latest trip start as clock texts."""
    return trips.agg(S.clock_text(F.max("last_dep")).alias("latest_departure"), S.clock_text(F.min("dep1")).alias("earliest_start"),
                     S.clock_text(F.max("dep1")).alias("latest_start"))
