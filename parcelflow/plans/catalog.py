"""Catalogue of model runs: which file versions each run used, and differences between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators.joins import only_in_each

NEVER_STARTED, NEVER_ENDED = 0, 2000000000


def run_times(files: DataFrame) -> DataFrame:
    """Start and end second per run folder from its marker files."""
    sec = F.col("modified").cast("timestamp").cast("double")
    full = F.concat("name", "ext")
    low = lambda names: F.floor(F.min(F.when(full.isin(names), sec))).cast("bigint")
    return files.groupBy("folder").agg(F.coalesce(low(K.RUN_START_FILES), F.lit(NEVER_STARTED)).alias("started"),
                                       F.coalesce(low(K.RUN_END_FILES), F.lit(NEVER_ENDED)).alias("ended"))


def run_inputs(files: DataFrame, outputs_to_keep: list[str] = ()) -> DataFrame:
    """Files changed before the run began, and wanted outputs written after it ended."""
    f = files.join(run_times(files), "folder")
    sec = F.col("modified").cast("timestamp").cast("double")
    wanted = F.lit(False)
    for o in outputs_to_keep:
        stem, ext = o.split(".")[0], "." + o.split(".")[-1]
        wanted = wanted | (F.col("name").contains(stem) & (F.col("ext") == ext))
    keep = (F.floor(sec) < F.col("started")) | ((sec > F.col("ended")) & wanted)
    return f.where(keep).select("folder", "name", "ext", "modified")


def run_manifest(files: DataFrame, outputs_to_keep: list[str] = (), supporting: bool = False) -> DataFrame:
    """(folder, file version) of every input file; all files count for supporting folders."""
    f = files if supporting else run_inputs(files, outputs_to_keep)
    return f.select("folder", S.file_version_key("name", "modified", "ext").alias("file_version"))


def unique_versions(manifest: DataFrame) -> DataFrame:
    return manifest.select("file_version").distinct()


def compare_runs(manifest: DataFrame, run_1: str, run_2: str, group: str | None = None) -> DataFrame:
    """File versions found in only one of two runs, names without extension."""
    cols = ([group] if group else []) + ["file_version"]
    a, b = (manifest.where(F.col("folder") == r).select(*cols).distinct() for r in (run_1, run_2))
    out = only_in_each(a, b, cols, names=(run_1, run_2), side="only_in")
    return out.withColumn("file_version", F.substring_index("file_version", ".", 1))


def rebuild_plan(manifest: DataFrame, run: str, source: str, destination: str) -> DataFrame:
    """Source file and target file for rebuilding one run."""
    m = manifest.where(F.col("folder") == run)
    return m.select(F.concat(F.lit(source + "/"), F.col("file_version")).alias("source_file"),
                    F.concat(F.lit(destination + "/"), S.original_file_name("file_version")).alias("target_file"))
