"""DBF files written from a DataFrame, one or more files per partition, as input for the reader."""

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Records of a file at most. The header holds their number, so a file is written when all of them are there.
FILE_RECORDS = 200_000


def write_dbf(df: DataFrame, fields: list[tuple[str, str, int, int]], path: str, kinds: dict[str, str] | None = None) -> None:
    """``fields``: (name, type N or C, width, decimals). Missing values become blanks. ``kinds`` declares a field as of another type than it is written."""
    def text(name, kind, width, dec):
        c = F.col(name)
        if kind == "N":
            s = c.cast(f"decimal(38,{dec})").cast("string")
            return F.lpad(F.coalesce(s, F.lit("")), width, " ")
        return F.rpad(F.coalesce(c, F.lit("")), width, " ")

    rows = df.select(F.concat(F.lit(" "), *[text(*f) for f in fields]).alias("record"))
    declared = [(n, (kinds or {}).get(n, k), w, d) for n, k, w, d in fields]
    parts = rows.mapInPandas(_writer(declared, path), "path string, n bigint")
    parts.agg(F.sum("n")).collect()


def _writer(fields, path):
    def run(batches):
        import struct
        import uuid

        import pandas as pd
        from pyarrow import fs
        system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(folder)
        length = 1 + sum(w for _, _, w, _ in fields)

        def written(records):
            out = f"{folder}/part-{uuid.uuid4().hex}"
            with system.open_output_stream(out) as f:
                f.write(struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(records) // length, 33 + 32 * len(fields), length))
                for name, kind, width, dec in fields:
                    f.write(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, dec))
                f.write(b"\r")
                f.write(records)
                f.write(b"\x1a")
            system.move(out, out + ".dbf")  # a failed attempt leaves no .dbf behind
            return pd.DataFrame({"path": [out + ".dbf"], "n": [len(records) // length]})

        records, some = bytearray(), False
        for b in batches:
            for r in b["record"]:
                if len(records) >= FILE_RECORDS * length:
                    yield written(records)
                    records, some = bytearray(), True
                records += r.encode("ascii")
        if records or not some:
            yield written(records)
    return run
