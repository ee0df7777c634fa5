"""DBF files as a Spark data source: ``spark.read.format("dbf").load(path)``.

Records have a fixed length, so a file is read in record ranges, one per task. A task reads its range in
blocks, turns each block into whole columns and returns Arrow batches.

Options: ``path`` (file, folder or glob on storage all executors see), ``encoding`` (default ascii),
``columns`` (comma-separated, only these are decoded), ``records_per_partition``.

A file ends at its first end mark, which may stand before the file's end, and a number field may hold decimals that its declaration doesn't
mention. ``read_dbf`` finds both in a first pass over the ranges, side by side, and reads the ranges in a second one.
"""

from __future__ import annotations

import json

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_RECORDS = 50_000


class RecordRange(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


def _filesystem(path: str):
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _list_files(path: str) -> list[str]:
    from fnmatch import fnmatch
    from pyarrow import fs
    system, p = _filesystem(path)
    prefix = path[: len(path) - len(p)]
    if "*" in p:
        folder, pattern = p.rsplit("/", 1)
        infos = [i for i in system.get_file_info(fs.FileSelector(folder)) if fnmatch(i.base_name, pattern)]
    else:
        info = system.get_file_info(p)
        infos = [info] if info.type == fs.FileType.File else [
            i for i in system.get_file_info(fs.FileSelector(p)) if i.extension.lower() == "dbf"]
    files = sorted(prefix + i.path for i in infos if i.type == fs.FileType.File)
    if not files:
        raise FileNotFoundError(f"no dbf file at {path}")
    return files


def read_header(path: str, encoding: str = "ascii") -> dict:
    """Record count and length, data offset, version and fields (name, type, length, decimals, offset)."""
    import struct
    system, p = _filesystem(path)
    with system.open_input_file(p) as f:
        head = f.read(32)
        n, data_at, record_length = struct.unpack("<IHH", head[4:12])
        fields, offset = [], 1
        while True:
            raw = f.read(32)
            if len(raw) < 32 or raw[:1] in (b"\r", b"\n"):
                break
            name = raw[:11].split(b"\0")[0].decode(encoding)
            kind, length, decimals = chr(raw[11]), raw[16], raw[17]
            if kind == "C":
                length, decimals = length | decimals << 8, 0
            if (kind == "I" and length != 4) or (kind == "L" and length != 1):
                raise ValueError(f"field {name}: type {kind} cannot have length {length}")
            fields.append((name, kind, length, decimals, offset))
            offset += length
        size = f.size()
    if record_length:
        n = max(0, (size - data_at) // record_length)  # the header's count is often stale
    return {"records": n, "length": record_length, "data_at": data_at, "version": head[0], "fields": fields}


def field_type(kind: str, decimals: int, version: int = 3) -> T.DataType:
    if kind == "N":
        return T.DoubleType() if decimals else T.LongType()
    if kind == "B" and version not in (0x30, 0x31, 0x32):
        raise ValueError("field type B is a memo field in this file")
    types = {"C": T.StringType(), "V": T.StringType(), "D": T.DateType(), "F": T.DoubleType(), "O": T.DoubleType(),
             "B": T.DoubleType(), "I": T.IntegerType(), "+": T.IntegerType(), "L": T.BooleanType(),
             "T": T.TimestampNTZType(), "@": T.TimestampNTZType(), "Y": T.DecimalType(19, 4), "0": T.BinaryType(),
             "M": T.StringType(), "G": T.BinaryType(), "P": T.BinaryType()}
    if kind not in types:
        raise ValueError(f"unknown field type {kind!r}")
    return types[kind]


def decode_column(kind: str, decimals: int, cells, encoding: str = "ascii"):
    """One column as an Arrow array: ``cells`` is a 2-d byte array with a row per record."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    n, width = cells.shape
    cells = np.ascontiguousarray(cells)
    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(cells)])

    if kind in "CV":
        if encoding in ("ascii", "utf-8"):
            if encoding == "ascii" and (cells > 127).any():
                raise ValueError("text is not ascii; give the file's encoding")
            text = raw.cast(pa.binary()).cast(pa.string())
        else:
            text = pa.array([w.decode(encoding) for w in raw.to_pylist()], pa.string())
        return pc.utf8_rtrim(text, "\0 ")
    if kind in "NF":
        text = pc.utf8_trim(raw.cast(pa.binary()).cast(pa.string()), " *\0\t")
        text = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
        if kind == "N":
            text = pc.replace_substring(text, ",", ".")
        if kind == "F" or decimals:
            return pc.cast(text, pa.float64())
        try:
            return pc.cast(text, pa.int64())
        except pa.ArrowInvalid:
            real = pc.cast(text, pa.float64())
            if not pc.all(pc.equal(pc.floor(real), real)).as_py():
                raise ValueError("a field declared without decimals holds decimals: read it with the option real_fields") from None
            return pc.cast(real, pa.int64())
    if kind in "I+":
        return pa.array(cells.view("<i4").reshape(n), pa.int32())
    if kind in "OB":
        return pa.array(cells.view("<f8").reshape(n), pa.float64())
    if kind == "Y":
        # the unscaled value of a decimal with four places is the stored integer
        wide = np.empty((n, 2), "<i8")
        wide[:, 0] = cells.view("<i8").reshape(n)
        wide[:, 1] = wide[:, 0] >> 63
        return pa.Decimal128Array.from_buffers(pa.decimal128(19, 4), n, [None, pa.py_buffer(wide)])
    if kind == "L":
        flags = cells.reshape(n)
        yes, no, unknown = (np.isin(flags, list(s)) for s in (b"TtYy", b"FfNn", b"? "))
        if not (yes | no | unknown).all():
            raise ValueError(f"illegal logical value {bytes(flags[~(yes | no | unknown)][:1])!r}")
        return pa.array(yes, pa.bool_(), mask=unknown)
    if kind == "D":
        blank = np.isin(cells, [0x20, 0x30, 0]).all(axis=1)
        digits = np.where(blank[:, None], np.frombuffer(b"19700101", np.uint8), cells[:, :8]).astype("int64") - 48
        y, m, d = (digits[:, a:b] @ (10 ** np.arange(b - a)[::-1]) for a, b in ((0, 4), (4, 6), (6, 8)))
        good = ((digits >= 0) & (digits <= 9)).all(axis=1) & (y > 0) & (m >= 1) & (m <= 12) & (d >= 1)
        month = ((np.where(good, y, 1970) - 1970) * 12 + np.where(good, m, 1) - 1).astype("datetime64[M]")
        day = month.astype("datetime64[D]") + (np.where(good, d, 1) - 1)
        good &= day.astype("datetime64[M]") == month
        if not good.all():
            raise ValueError(f"invalid date {bytes(cells[~good][0])!r}")
        return pa.array(day, pa.date32(), mask=blank)
    if kind in "T@":
        parts = cells.view("<u4").reshape(n, 2).astype("int64")
        none = np.isin(cells, list(b" \t\r\n\x0b\x0c")).all(axis=1) | (parts[:, 0] == 0)
        micros = (parts[:, 0] - 2440588) * 86_400_000_000 + parts[:, 1] * 1000  # Julian day of 1970-01-01
        return pa.array(micros, pa.timestamp("us"), mask=none)
    if kind == "0":
        return raw.cast(pa.binary())
    # memo contents live in a second file that is not read
    return pa.nulls(n, pa.string() if kind == "M" else pa.binary())


def _real_fields(options: dict) -> set[str]:
    """Names in the option ``real_fields``: whole-number fields by their declaration that hold decimals."""
    return {c.strip() for c in options.get("real_fields", "").split(",") if c.strip()}


def records_before_mark(path: str, header: dict) -> int:
    """How many records stand before the first end mark (0x1A in the place of the deletion flag), or all of them."""
    system, p = _filesystem(path)
    size = header["length"]
    with system.open_input_file(p) as f:
        f.seek(header["data_at"])
        for first in range(0, header["records"], BLOCK_RECORDS):
            raw = f.read(min(BLOCK_RECORDS, header["records"] - first) * size)
            at = raw[::size].find(b"\x1a")
            if at >= 0:
                return first + at
    return header["records"]


def _size_ranges(path: str, encoding: str, per_task: int, ends: dict[str, int | None]) -> list[RecordRange]:
    """Ranges of records by the files' sizes, up to the known ends."""
    out = []
    for f in _list_files(path):
        n = read_header(f, encoding)["records"]
        n = n if ends.get(f) is None else min(n, ends[f])
        out += [RecordRange(f, first, max(0, min(per_task, n - first))) for first in range(0, max(n, 1), per_task)]
    return out


def holds_decimals(cells) -> bool:
    """Whether a number field's cells hold anything but whole numbers and blanks."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    if not np.isin(cells, [0x2E, 0x2C]).any():  # no point, no comma
        return False
    try:
        real = decode_column("N", 1, cells)
    except pa.ArrowInvalid:
        return False
    return bool(pc.any(pc.not_equal(pc.floor(real), real)).as_py())


class DbfSurvey(DataSourceReader):
    """First pass: the first end mark of each range, and the whole-number fields that hold decimals before it."""

    def __init__(self, options: dict, path: str):
        self.path, self.encoding, self.per_task = path, options.get("encoding", "ascii"), int(options["records_per_partition"])

    def partitions(self):
        return _size_ranges(self.path, self.encoding, self.per_task, {})

    def read(self, part):
        import numpy as np
        h = read_header(part.path, self.encoding)
        size, mark, real = h["length"], None, set()
        numbers = [(name, length, at) for name, kind, length, decimals, at in h["fields"] if kind == "N" and not decimals]
        system, p = _filesystem(part.path)
        with system.open_input_file(p) as f:
            for done in range(0, part.count, BLOCK_RECORDS):
                f.seek(h["data_at"] + (part.first + done) * size)
                raw = f.read(min(BLOCK_RECORDS, part.count - done) * size)
                rows = np.frombuffer(raw, dtype=np.uint8)[: len(raw) // size * size].reshape(-1, size)
                end = np.flatnonzero(rows[:, 0] == 0x1A)
                rows = rows[: end[0]] if len(end) else rows
                kept = rows[rows[:, 0] == 0x20]
                real |= {name for name, length, at in numbers if name not in real and len(kept) and holds_decimals(kept[:, at:at + length])}
                if len(end):
                    mark = part.first + done + int(end[0])
                    break
        yield (part.path, part.first, mark, sorted(real))


class DbfReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict, path: str):
        self.names = [f.name for f in schema.fields]
        self.path, self.encoding = path, options.get("encoding", "ascii")
        self.real = _real_fields(options)
        self.per_task = int(options["records_per_partition"]) if "records_per_partition" in options else None
        self.ends = json.loads(options["ends"]) if "ends" in options else None
        memo = [f.name for f in schema.fields if (f.metadata or {}).get("dbf_kind") in ("M", "G", "P")]
        if memo and options.get("ignore_missing_memofile", "false").lower() != "true":
            raise ValueError(f"memo files are not read: leave out {', '.join(memo)}, or set ignore_missing_memofile for NULLs")

    def partitions(self):
        """Ranges up to the known ends after a survey. Else a task per file, which reads to the end mark; or, with ``records_per_partition``, ranges
        up to the mark, which is looked for first."""
        if self.ends is not None:
            return _size_ranges(self.path, self.encoding, self.per_task, self.ends)
        out = []
        for f in _list_files(self.path):
            h = read_header(f, self.encoding)
            n = h["records"] if self.per_task is None else records_before_mark(f, h)
            step = self.per_task or max(n, 1)
            for first in range(0, max(n, 1), step):
                out.append(RecordRange(f, first, max(0, min(step, n - first))))
        return out

    def read(self, part):
        import numpy as np
        import pyarrow as pa
        h = read_header(part.path, self.encoding)
        fields = {f[0]: f for f in h["fields"]}
        system, p = _filesystem(part.path)
        size = h["length"]
        with system.open_input_file(p) as f:
            done = 0
            while done < part.count:
                take = min(BLOCK_RECORDS, part.count - done)
                f.seek(h["data_at"] + (part.first + done) * size)
                raw = f.read(take * size)
                rows = np.frombuffer(raw, dtype=np.uint8)[: len(raw) // size * size].reshape(-1, size)
                end = np.flatnonzero(rows[:, 0] == 0x1A)
                finished = len(end) > 0 or len(rows) < take
                rows = rows[: end[0]] if len(end) else rows
                rows = rows[rows[:, 0] == 0x20]
                cols = []
                for name in self.names:
                    _, kind, length, decimals, at = fields[name]
                    cols.append(decode_column(kind, decimals or int(kind == "N" and name in self.real), rows[:, at:at + length], self.encoding))
                if len(rows):
                    yield pa.RecordBatch.from_arrays(cols, names=self.names)
                if finished:
                    return
                done += take


class DbfDataSource(DataSource):
    @classmethod
    def name(cls):
        return "dbf"

    def schema(self):
        if self.options.get("survey") == "true":
            return "file string, first long, mark long, real array<string>"
        h = read_header(_list_files(self.options["path"])[0], self.options.get("encoding", "ascii"))
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        real = _real_fields(self.options)
        h["fields"] = [(n, k, w, d or int(k == "N" and n in real), at) for n, k, w, d, at in h["fields"]]
        fields = [T.StructField(n, field_type(k, d, h["version"]), True, {"dbf_kind": k} if k in "MGP" else None) for n, k, _, d, _ in h["fields"]
                  if not wanted or n in wanted]
        return T.StructType(fields)

    def reader(self, schema):
        if self.options.get("survey") == "true":
            return DbfSurvey(self.options, self.options["path"])
        return DbfReader(schema, self.options, self.options["path"])


def register_dbf(spark: SparkSession) -> None:
    """Make ``format("dbf")`` known; the class travels with the job, executors need no installation."""
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(DbfDataSource)


def read_dbf(spark: SparkSession, path: str, records_a_task: int = 1_000_000, **options) -> DataFrame:
    """DBF files as a table, in two passes over ranges of ``records_a_task`` records; ``options`` are those of the source.

    The first pass looks in all ranges at once for end marks and for number fields that hold decimals without saying so; per file the smallest
    mark is its end. The second pass reads the ranges before the ends, such fields as doubles. One row per file and the fields' names reach the driver.
    """
    from parcelflow.session import materialize, release
    register_dbf(spark)
    reader = lambda more: spark.read.format("dbf").options(**options, records_per_partition=records_a_task, **more).load(path)
    seen = materialize(reader({"survey": "true"}), "dbf-survey")
    ends = seen.groupBy("file").agg(F.min("mark").alias("end"))
    known = {r["file"]: r["end"] for r in ends.collect()}
    before = seen.join(ends, "file").where(F.col("end").isNull() | (F.col("first") < F.col("end")))
    real = {r["name"] for r in before.select(F.explode("real").alias("name")).distinct().collect()} | _real_fields(options)
    release(seen)
    return reader({"ends": json.dumps(known), "real_fields": ",".join(sorted(real))})
