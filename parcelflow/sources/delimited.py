"""Typed delimited files, header repair, malformed-row reports, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = {"csv": ",", "tsv": "\t", "txt": ","}
CORRUPT = "_corrupt"


def _extension(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str | None = None, header: bool = True,
                   require_rows: bool = True) -> DataFrame:
    """Typed csv, tsv or txt. The separator follows the extension unless given; a file without rows is an error."""
    sep = sep or SEPARATORS.get(_extension(path), ",")
    df = spark.read.schema(schema).csv(path, sep=sep, header=header, mode="FAILFAST", enforceSchema=True)
    if require_rows and df.limit(1).isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def read_dat(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless file with single blanks between fields."""
    return spark.read.schema(schema).csv(path, sep=" ", header=False, mode="FAILFAST")


def repair_header(cols: list[str]) -> list[str]:
    """An empty leading name becomes ``FIELD0``."""
    return ["FIELD0", *cols[1:]] if cols and cols[0] == "" else list(cols)


def header_names(spark: SparkSession, path: str, sep: str | None = None) -> list[str]:
    """Column names of the header line, repaired."""
    sep = sep or SEPARATORS.get(_extension(path), ",")
    line = spark.read.text(path).limit(1).first()
    if line is None:
        raise ValueError(f"no header in {path}")
    return repair_header(line[0].split(sep))


def malformed_report(spark: SparkSession, path: str, names: list[str], sep: str | None = None,
                     header: bool = True) -> DataFrame:
    """One row: data rows, rows whose number of fields differs from the header, an and an example."""
    sep = sep or SEPARATORS.get(_extension(path), ",")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(schema).csv(path, sep=sep, header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    # every field is used, as the parser checks only rows it parses in full
    bad = F.col(CORRUPT).isNotNull() & (F.length(F.concat_ws("", *names)) >= 0)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(bad, 1)).alias("n_malformed"),
                    F.min(F.when(bad, F.col(CORRUPT))).alias("example"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_with_fallback(spark: SparkSession, primary: str, fallback: str, schema: T.StructType, cols: list[str],
                       zero_cols: list[str]) -> DataFrame:
    """Pruned columns of the primary file; if it is missing, of the fallback file with ``zero_cols`` as 0."""
    if path_exists(spark, primary):
        return read_delimited(spark, primary, schema).select(*cols, *zero_cols)
    known = T.StructType([f for f in schema.fields if f.name not in zero_cols])
    df = read_delimited(spark, fallback, known)
    return df.select(*cols, *[F.lit(0).cast(schema[c].dataType).alias(c) for c in zero_cols])
