"""GTFS feeds of several agencies as one set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.operators.joins import dealt, union_all

# --- fixed values: feed columns in use ---------------------------------------------------------
GTFS_COLUMNS = {
    "routes": "agency_id string, route_id string, route_long_name string",
    "trips": "route_id string, trip_id string, direction_id string, service_id string, shape_id string",
    "stop_times": "trip_id string, departure_time string, stop_id string, stop_sequence int",
    "calendar": "service_id string, monday int, saturday int, sunday int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
}


def read_gtfs_table(spark: SparkSession, folder: str, spec: dict[str, dict[str, str]], table: str) -> DataFrame:
    """One feed table over all agencies; ``spec`` maps an agency to its file per table.

    Columns are taken by header name, whatever their order in the file.
    """
    wanted = [c.split() for c in GTFS_COLUMNS[table].split(", ")]
    parts = []
    for agency, files in spec.items():
        raw = spark.read.csv(f"{folder}/{agency}/{files[table]}", header=True)  # header read only, all text
        cols = [F.col(c).try_cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in wanted]
        parts.append(raw.select(F.lit(agency).alias("agency"), *cols))
    return union_all(parts)


def read_gtfs(spark: SparkSession, folder: str, spec: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    return {t: read_gtfs_table(spark, folder, spec, t) for t in GTFS_COLUMNS if all(t in f for f in spec.values())}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the text lines of one file, or of a folder's files, numbered from 1 in each file, however it is split."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
                                        F.monotonically_increasing_id().alias("id"))
    blocks = text.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return text.join(blocks, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def read_checked_table(spark: SparkSession, folder: str, spec: dict[str, dict[str, str]], table: str) -> tuple[DataFrame, DataFrame]:
    """One feed table over all agencies, and the rows that cannot be read.

    The second is (agency, table, file, line, reason): one row per line that has not as many fields as its header, or a text where a number is due;
    the first such column is named. These lines are left out of the table. Lines without any text are neither. A record is one line.
    """
    wanted = [c.split() for c in GTFS_COLUMNS[table].split(", ")]
    good, bad = [], []
    for agency, files in spec.items():
        path = f"{folder}/{agency}/{files[table]}"
        header = spark.read.csv(path, header=True).columns  # header read only
        shape = ", ".join(f"`{c}` string" for c in header) + ", `__corrupt` string"
        fields = F.from_csv("value", F.lit(shape), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
        lines = numbered_lines(spark, path).where((F.col("line") > 1) & (F.trim("value") != "")).withColumn("r", fields)
        value = {c: F.col("r").getField(c) for c in header}
        typed = [F.when(value[c].isNotNull() & (F.trim(value[c]) != "") & value[c].try_cast(t).isNull(), F.concat(F.lit(f"{c} is no {t}: "), value[c]))
                 for c, t in wanted if t != "string" and c in header]
        reason = F.coalesce(F.when(F.col("r").getField("__corrupt").isNotNull(), F.lit(f"not {len(header)} fields")), *typed, F.lit(None).cast("string"))
        lines = lines.withColumn("reason", reason)
        cols = [value[c].try_cast(t).alias(c) if c in header else F.lit(None).cast(t).alias(c) for c, t in wanted]
        good.append(lines.where("reason IS NULL").select(F.lit(agency).alias("agency"), *cols))
        bad.append(lines.where("reason IS NOT NULL").select(F.lit(agency).alias("agency"), F.lit(table).alias("table"), "file", "line", "reason"))
    return union_all(good), union_all(bad)


def read_gtfs_checked(spark: SparkSession, folder: str, spec: dict[str, dict[str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The feed tables as ``read_gtfs`` gives them, and all lines of the feeds that cannot be read."""
    found = {t: read_checked_table(spark, folder, spec, t) for t in GTFS_COLUMNS if all(t in f for f in spec.values())}
    return {t: good for t, (good, _) in found.items()}, union_all([bad for _, bad in found.values()])


def read_spec(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Agency file list: agency, route_file, trip_file, stop_time_file, calendar_file, stops_file, shapes_file."""
    names = {"routes": "route_file", "trips": "trip_file", "stop_times": "stop_time_file", "calendar": "calendar_file",
             "shapes": "shapes_file"}
    rows = spark.read.csv(path, header=True).collect()  # one row per agency
    return {r["agency"]: {t: r[c] for t, c in names.items() if c in r.asDict()} for r in rows}


def read_shapes(spark: SparkSession, folder: str, spec: dict[str, dict[str, str]]) -> DataFrame:
    """Shape points with their agency and a display key."""
    s = read_gtfs_table(spark, folder, spec, "shapes")
    return s.withColumn("shape_uid", F.concat("agency", "shape_id"))


def stop_events(tables: dict[str, DataFrame]) -> DataFrame:
    """Routes with their trips, stop times and service days, as one wide table. Trips and stop times meet in as many tasks as a shuffle has."""
    t, trip = tables, ["agency", "trip_id"]
    return (dealt(t["routes"].join(t["trips"], ["agency", "route_id"], "left"), trip)
            .join(dealt(t["stop_times"], trip), trip, "left")
            .join(t["calendar"], ["agency", "service_id"], "left"))
