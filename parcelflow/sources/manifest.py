"""Files of run folders, listed without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_run_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """folder, name, ext, modified, length of every file directly in the folders. Contents are pruned away."""
    files = spark.read.format("binaryFile").load([f"{f.rstrip('/')}/*" for f in folders]).select("path", "modificationTime", "length")
    full = F.substring_index("path", "/", -1)
    dotted = full.contains(".")
    return files.select(
        F.regexp_replace(F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)"), "^file:/*", "/").alias("folder"),
        F.when(dotted, F.regexp_extract(full, r"^(.*)\.[^.]*$", 1)).otherwise(full).alias("name"),
        F.when(dotted, F.concat(F.lit("."), F.substring_index(full, ".", -1))).otherwise(F.lit("")).alias("ext"),
        F.col("modificationTime").alias("modified"), "length")
