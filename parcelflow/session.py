"""Session helpers: where shared scratch data lives and how to cut lineage."""

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. It must be one that the driver and all executors see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share; reduced results are written there.")
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses; all of a session's paths are removed when its JVM ends."""
    root = f"{shared_folder(spark)}/parcelflow-{spark.sparkContext.applicationId}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        files.mkdirs(place)
        files.deleteOnExit(place)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives executor loss, cuts lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    for paths in getattr(_SCOPES, "open", []):
        paths.append(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The list of the paths that ``materialize`` writes on this thread while the scope is open, for ``release_paths`` later."""
    _SCOPES.open = [*getattr(_SCOPES, "open", []), []]
    try:
        yield _SCOPES.open[-1]
    finally:
        _SCOPES.open = _SCOPES.open[:-1]


def release_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch data; nothing that is still to be computed may read it."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, as ``release_paths``; other DataFrames are left alone."""
    for df in written:
        release_paths(df.sparkSession, [df._scratch_path] if "_scratch_path" in df.__dict__ else [])
