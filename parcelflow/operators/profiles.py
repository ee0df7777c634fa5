"""Column profiling and type narrowing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_RANGES = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2147483648, 2147483647)]
CATEGORY_SHARE = 0.4


def column_profile(df: DataFrame) -> DataFrame:
    """One row: bounds of whole-number columns, largest float round-trip error, distinct share of texts."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            aggs += [F.min(c).alias(f"min_{f.name}"), F.max(c).alias(f"max_{f.name}")]
        elif isinstance(f.dataType, T.DoubleType):
            aggs.append(F.max(F.abs(c - c.cast("float").cast("double"))).alias(f"err_{f.name}"))
        elif isinstance(f.dataType, T.StringType):
            aggs.append(F.approx_count_distinct(c).alias(f"distinct_{f.name}"))
    return df.agg(*aggs)


def narrow_types(df: DataFrame, max_float_error: float = 0.0) -> tuple[DataFrame, list[str]]:
    """The same data in the smallest types that hold it, and the texts worth a dictionary.

    Parquet dictionary-encodes repeated texts by itself; the list only reports them.
    """
    p = column_profile(df).first()  # one row of bounds
    casts, categories = [], []
    for f in df.schema.fields:
        c, t = F.col(f.name), None
        if f"min_{f.name}" in p and p[f"min_{f.name}"] is not None:
            lo, hi = p[f"min_{f.name}"], p[f"max_{f.name}"]
            t = next((n for n, a, b in INT_RANGES if a <= lo and hi <= b), "bigint")
        elif f"err_{f.name}" in p and p[f"err_{f.name}"] is not None:
            t = "float" if p[f"err_{f.name}"] <= max_float_error else None
        elif f"distinct_{f.name}" in p and p["n_rows"] and p[f"distinct_{f.name}"] / p["n_rows"] < CATEGORY_SHARE:
            categories.append(f.name)
        casts.append(c.cast(t).alias(f.name) if t else c)
    return df.select(*casts), categories
