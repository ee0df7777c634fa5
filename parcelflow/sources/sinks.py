"""Writers: tables, scenario partitions, the scenario log, retirement, text."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCENARIO_KEYS = ["scenario_year", "scenario_id", "lu_scenario"]
STATUS_CREATED, STATUS_ALL, STATUS_KEPT = "created", "deleted all tables", "deleted raw/theme tables, kept combined table"
LOG_SCHEMA = T.StructType([
    T.StructField("scenario_year", T.IntegerType()), T.StructField("scenario_code", T.IntegerType()),
    T.StructField("scenario_desc", T.StringType()), T.StructField("run_time", T.TimestampType()),
    T.StructField("av_tnc", T.StringType()), T.StructField("table_status", T.StringType()),
    T.StructField("run_folder", T.StringType()), T.StructField("shared_externally", T.IntegerType()),
    T.StructField("user_name", T.StringType()), T.StructField("lu_scenario", T.StringType())])


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table."""
    df.write.mode("overwrite").parquet(path)


def publish_scenario(df: DataFrame, path: str, year: int, scenario_id: int, land_use: str) -> None:
    """Write one scenario into the shared table, replacing only that scenario's partition."""
    keys = dict(zip(SCENARIO_KEYS, (F.lit(year), F.lit(scenario_id), F.lit(land_use))))
    (df.withColumns(keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*SCENARIO_KEYS).parquet(path))


class PublishRefused(RuntimeError):
    """A scenario must not be overwritten now: it is shared with others, or another writer is at it."""


def publish_guarded(df: DataFrame, path: str, log_path: str, year: int, scenario_id: int, land_use: str, **entry) -> None:
    """Publish one scenario and log it, or leave everything as it was.

    A lock file, which only one writer can create, keeps a second writer out. The data is written to a staging folder that readers don't see,
    the log is asked again whether the scenario is shared meanwhile, and one rename puts the new folder in place; the old one is set aside
    before and comes back if that fails. A write that fails leaves the published data and the log untouched. ``entry`` are fields of the log.
    """
    spark = df.sparkSession
    if _log_exists(spark, log_path) and is_shared(read_log(spark, log_path), year, scenario_id):
        raise PublishRefused(f"Scenario {scenario_id} of {year} is shared.")
    part = "/".join(f"{k}={v}" for k, v in zip(SCENARIO_KEYS, (year, scenario_id, land_use)))
    lock, fs = _file_system(spark, f"{path}/_locks/{part.replace('/', '-')}")
    if not _create(fs, lock):
        raise PublishRefused(f"Scenario {scenario_id} of {year} is being written.")
    name = uuid.uuid4().hex
    staged, old, place = (_file_system(spark, f"{path}/{x}")[0] for x in (f"_staging/{name}", f"_replaced/{name}", part))
    try:
        df.write.parquet(staged.toString())
        if _log_exists(spark, log_path) and is_shared(read_log(spark, log_path), year, scenario_id):
            raise PublishRefused(f"Scenario {scenario_id} of {year} is shared.")
        replaces = fs.exists(place)
        fs.mkdirs(place.getParent())
        fs.mkdirs(old.getParent())
        if replaces and not fs.rename(place, old):
            raise OSError(f"The published folder {place.toString()} could not be set aside.")
        if not fs.rename(staged, place):
            if replaces:
                fs.rename(old, place)
            raise OSError(f"The staged folder could not be moved to {place.toString()}.")
        scenario_log_append(spark, log_path, scenario_year=year, scenario_code=scenario_id, lu_scenario=land_use, **entry)
        if replaces:
            fs.delete(old, True)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)
        fs.delete(lock, False)


def _log_exists(spark: SparkSession, log_path: str) -> bool:
    p, fs = _file_system(spark, log_path)
    return fs.exists(p)


def _create(fs, path) -> bool:
    """Create an empty file, if there is none; False if there is."""
    fs.mkdirs(path.getParent())
    return fs.createNewFile(path)


def scenario_log_append(spark: SparkSession, path: str, **entry) -> None:
    """Add one line to the scenario log."""
    now = F.current_timestamp()
    row = spark.range(1).select(*[
        (now if f.name == "run_time" and entry.get("run_time") is None
         else F.lit(entry.get(f.name, STATUS_CREATED if f.name == "table_status" else None))).cast(f.dataType).alias(f.name)
        for f in LOG_SCHEMA.fields])
    row.coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def shared_scenarios(log: DataFrame) -> DataFrame:
    """Scenarios shared with others; they must not be overwritten or retired."""
    return log.where((F.col("table_status") == STATUS_CREATED) & (F.col("shared_externally") == 1)).select(
        "scenario_year", "scenario_code").distinct()


def is_shared(log: DataFrame, year: int, scenario_id: int) -> bool:
    return not shared_scenarios(log).where((F.col("scenario_year") == year) & (F.col("scenario_code") == scenario_id)).isEmpty()


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def retire_scenarios(spark: SparkSession, tables: dict[str, str], log_path: str, new_log_path: str,
                     scenarios: list[tuple[int, int]], keep_combined: bool = True, combined: str = "combined") -> list[tuple[int, int]]:
    """Drop the data of scenarios that are not shared and write the log with their new status to a new path.

    ``tables`` maps a table to its folder, partitioned by scenario. A scenario is dropped by removing its
    partition folders, so no data is rewritten. Returns the scenarios dropped.
    """
    log = read_log(spark, log_path)
    wanted = spark.createDataFrame(scenarios, "scenario_year int, scenario_code int")
    gone = wanted.join(shared_scenarios(log), ["scenario_year", "scenario_code"], "left_anti")
    dropped = [(r[0], r[1]) for r in gone.collect()]  # no more rows than the caller passed in
    for name, folder in tables.items():
        if keep_combined and name == combined:
            continue
        for year, code in dropped:
            p, fs = _file_system(spark, f"{folder}/scenario_year={year}/scenario_id={code}")
            fs.delete(p, True)
    status = STATUS_KEPT if keep_combined else STATUS_ALL
    mark = gone.withColumn("__new", F.lit(status))
    out = log.join(mark, ["scenario_year", "scenario_code"], "left").withColumn(
        "table_status", F.coalesce("__new", "table_status")).select(*[f.name for f in LOG_SCHEMA.fields])
    out.write.mode("errorifexists").parquet(new_log_path)
    return dropped


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_text_parts(df: DataFrame, group: list[str], order: list[str], text: str, path: str) -> None:
    """Ordered text: a group stays whole in one part, and its rows are in order."""
    (df.repartition(*group).sortWithinPartitions(*group, *order)
     .select(F.col(text).alias("value")).write.mode("overwrite").text(path))


ROW_NUMBER, _PART, _ROW = "row_number", "__part", "__row"


def write_ordered(df: DataFrame, order: list[str], path: str, parts: int | None = None) -> None:
    """Rows in one order over all parts, NULLs first: range partitions from sampled bounds, sorted inside, each row with its part and place in it."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id()  # the part's number, and 33 bits of the place in it
    ranged = ranged.sortWithinPartitions(*order).withColumns({_PART: F.shiftright(place, 33).cast("int"), _ROW: place.bitwiseAND((1 << 33) - 1)})
    ranged.write.mode("overwrite").parquet(path)


class OutOfOrder(ValueError):
    """Rows that are not in the stated order."""


def read_ordered(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """Rows of ``write_ordered`` with their row number from 1, after a check of the order within and across the parts.

    The check reads the order columns only. Across parts it compares each one's first row with the last one's before; within a part each row
    with the one before it, in windows of one part, which is as large as its writer's task was.
    """
    rows = spark.read.parquet(path)
    key = F.struct(*order)
    parts = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    by_part = Window.orderBy(_PART)  # one row per part
    parts = parts.withColumns({"before": F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "earlier": F.lag("high").over(by_part)})
    inside = Window.partitionBy(_PART).orderBy(_ROW)
    wrong = rows.select(_PART, _ROW, key.alias("key")).withColumn("earlier", F.lag("key").over(inside)).where("key < earlier")
    if not parts.where("low < earlier").isEmpty() or not wrong.isEmpty():
        raise OutOfOrder(f"The rows of {path} are not in the order of {', '.join(order)}.")
    numbered = rows.join(parts.select(_PART, "before"), _PART)
    return numbered.withColumn(ROW_NUMBER, F.col("before") + F.col(_ROW) + 1).drop(_PART, _ROW, "before")


def ledger_append(new: DataFrame, path: str, schema: str = "folder string, file_version string") -> None:
    """Append the file versions of run folders the ledger does not have yet."""
    spark = new.sparkSession
    p, fs = _file_system(spark, path)
    if fs.exists(p):
        known = spark.read.schema(schema).parquet(path).select("folder").distinct()
        new = new.join(known, "folder", "left_anti")
    new.write.mode("append").parquet(path)
