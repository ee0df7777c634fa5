import struct

import pytest
from pyspark.sql import functions as F

from parcelflow.sources import dbf, delimited, gtfs, linefile, manifest, sinks
from parcelflow.session import scratch_path

LIN = """; header comment
LINE NAME="RT1_A", LONGNAME="River Line", MODE=3, COLOR=2, OPERATOR=7, HEADWAY[1]=12, HEADWAY[3]=14,
  TIMEFAC[1]=1.1, N=1,-2,TF=1.5,3,

  4, -5, TF=2,
  N=6
;LINE NAME="OLD_A", MODE=3, N=9,8
LINE NAME="RT2_B", MODE=1, HEADWAY=30,
 NODES=6,-7,8
  LINE NAME="RT1_B", MODE=3,
  N=4,3
LINE NAME="RT2_B", MODE=2, HEADWAY=20,
 N=10,-11
"""


def test_line_file(spark, tmp_path):
    p = tmp_path / "a.lin"
    p.write_text(LIN)
    lines, nodes = linefile.read_line_file(spark, str(p))
    got = {r.line_name: r for r in lines.collect()}
    assert set(got) == {"RT1_A", "RT2_B", "RT1_B"}
    assert got["RT1_A"].headway1 == 12 and got["RT1_A"].headway2 == 0 and got["RT1_A"].longname == "River Line"
    assert got["RT2_B"].mode == 2 and got["RT2_B"].headway1 == 20  # last record wins; name without [1]
    n = {(r.line_name, r.seq): (r.node, r.stop, r.tf) for r in nodes.collect()}
    assert [n["RT1_A", i] for i in range(6)] == [
        ("1", "Y", "0"), ("2", "N", "0"), ("3", "Y", "1.5"), ("4", "Y", "1.5"), ("5", "N", "1.5"), ("6", "Y", "2")]
    assert [n["RT2_B", i] for i in range(2)] == [("10", "Y", "0"), ("11", "N", "0")]


def test_line_file_same_for_any_split(spark, tmp_path):
    p = tmp_path / "b.lin"
    body = "".join(f'LINE NAME="L{i}_A", MODE=3, HEADWAY[1]={i},\n N=1,-{i + 2},TF={i},{i + 3},\n {i + 4}\n' for i in range(400))
    p.write_text(body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = []
        for size in ("128m", "2k", "999b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines, nodes = linefile.read_line_file(spark, str(p))
            got.append((sorted(map(tuple, lines.collect())), sorted(map(tuple, nodes.collect()))))
        assert len(got[0][0]) == 400 and len(got[0][1]) == 1600
        assert got[0] == got[1] == got[2]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_file_round_trip(spark, tmp_path):
    p = tmp_path / "a.lin"
    p.write_text(LIN)
    lines, nodes = linefile.read_line_file(spark, str(p))
    out = str(tmp_path / "out")
    linefile.write_line_file(lines, nodes, out)
    text = "\n".join(r.value for r in spark.read.text(out).collect())
    assert 'LINE NAME="RT1_A"' in text and "TF=1.5, N=3" in text
    l2, n2 = linefile.read_line_file(spark, out)
    assert sorted(map(tuple, n2.collect())) == sorted(map(tuple, nodes.collect()))
    assert sorted(map(tuple, l2.select(*lines.columns).collect())) == sorted(map(tuple, lines.collect()))
    linefile.write_line_tables(lines, nodes, str(tmp_path / "tables"))
    l3, n3 = linefile.read_line_tables(spark, str(tmp_path / "tables"))
    assert sorted(map(tuple, n3.collect())) == sorted(map(tuple, nodes.select(*n3.columns).collect()))
    assert l3.count() == lines.count()


def write_dbf(path, fields, records, version=3, deleted=()):
    length = 1 + sum(f[2] for f in fields)
    with open(path, "wb") as f:
        f.write(struct.pack("<BBBBIHH20x", version, 24, 1, 1, len(records), 33 + 32 * len(fields), length))
        for name, kind, width, dec in fields:
            low, high = (width & 255, width >> 8) if kind == "C" else (width, dec)
            f.write(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), low, high))
        f.write(b"\r")
        for i, r in enumerate(records):
            f.write((b"*" if i in deleted else b" ") + b"".join(r))
        f.write(b"\x1a")


def test_dbf_memo_needs_the_option(spark, tmp_path):
    p = str(tmp_path / "signs.dbf")
    fields = [("SIGN", "C", 12, 0), ("PUT_UP", "D", 8, 0), ("NOTES", "M", 10, 0)]
    rec = lambda n, d: [n.ljust(12).encode(), d.encode(), b" " * 10]
    write_dbf(p, fields, [rec("stop", "20110405"), rec("removed", "20120607"), rec("yield", "20130809")], deleted=(1,))
    dbf.register_dbf(spark)
    with pytest.raises(Exception, match="ignore_missing_memofile"):
        spark.read.format("dbf").load(p).collect()
    rows = spark.read.format("dbf").option("ignore_missing_memofile", "true").load(p).collect()
    assert [(r.SIGN, str(r.PUT_UP), r.NOTES) for r in rows] == [("stop", "2011-04-05", None), ("yield", "2013-08-09", None)]
    assert spark.read.format("dbf").option("columns", "SIGN").load(p).count() == 2


def test_dbf_count_in_the_header_is_not_trusted(spark, tmp_path):
    p = tmp_path / "stale.dbf"
    write_dbf(str(p), [("ID", "N", 4, 0)], [[str(i).rjust(4).encode()] for i in range(10)])
    dbf.register_dbf(spark)
    data = bytearray(p.read_bytes())
    for count in (0, 3, 10, 99):
        data[4:8] = struct.pack("<I", count)
        p.write_bytes(bytes(data))
        assert spark.read.format("dbf").load(str(p)).count() == 10


@pytest.mark.parametrize("per", [None, 1, 2, 7])
def test_dbf_ends_at_the_first_mark(spark, tmp_path, per):
    p = tmp_path / "marked.dbf"
    write_dbf(str(p), [("ID", "N", 4, 0)], [[str(i).rjust(4).encode()] for i in range(10)])
    data = bytearray(p.read_bytes())
    data[33 + 32 + 4 * 5] = 0x1A
    p.write_bytes(bytes(data))
    dbf.register_dbf(spark)
    reader = spark.read.format("dbf")
    reader = reader.option("records_per_partition", per) if per else reader
    assert sorted(r.ID for r in reader.load(str(p)).collect()) == [0, 1, 2, 3]


def test_dbf_decimals_in_a_whole_number_field(spark, tmp_path):
    p = str(tmp_path / "n.dbf")
    write_dbf(p, [("X", "N", 5, 0)], [[b" 2.75"], [b"    4"]])
    dbf.register_dbf(spark)
    assert [r.X for r in spark.read.format("dbf").option("real_fields", "X").load(p).collect()] == [2.75, 4.0]


def test_dbf_types_and_splits(spark, tmp_path):
    p = str(tmp_path / "t.dbf")
    fields = [("ID", "N", 6, 0), ("V", "N", 8, 2), ("F", "F", 8, 2), ("I", "I", 4, 0), ("L", "L", 1, 0), ("Y", "Y", 8, 0),
              ("O", "O", 8, 0), ("T", "T", 8, 0), ("TXT", "C", 300, 0)]
    recs = []
    for i in range(1000):
        recs.append([str(i).rjust(6).encode(), (f"{i / 4:8.2f}".encode() if i % 5 else b"********"), b" " * 8 if i % 3 else b"    0.01",
                     struct.pack("<i", -i), b"TF? "[i % 4:i % 4 + 1], struct.pack("<q", i * 10001), struct.pack("<d", i / 8),
                     struct.pack("<II", 2440588 + i, 1500) if i % 2 else b" " * 8, (f"row {i}".ljust(300)).encode()])
    write_dbf(p, fields, recs, deleted=(10, 500))
    dbf.register_dbf(spark)
    results = []
    for per in (10_000, 97, 1):
        if per == 1:
            per = 333
        df = spark.read.format("dbf").option("records_per_partition", per).load(p)
        results.append(sorted(map(tuple, df.collect())))
    assert len(results[0]) == 998 and results[0] == results[1] == results[2]
    r = {t[0]: t for t in results[0]}
    assert r[5][1] is None and r[6][1] == 1.5 and r[1][2] is None and r[3][2] == 0.01 and r[7][3] == -7
    assert [r[i][4] for i in (0, 1, 2, 3)] == [True, False, None, None] and str(r[3][5]) == "3.0003" and r[4][6] == 0.5
    assert r[2][7] is None and str(r[1][7]) == "1970-01-02 00:00:01.500000" and r[9][8] == "row 9"
    only = spark.read.format("dbf").option("columns", "ID,TXT").load(p)
    assert only.columns == ["ID", "TXT"] and only.count() == 998


def test_dbf_bad_headers(tmp_path):
    import numpy as np
    p = str(tmp_path / "bad.dbf")
    write_dbf(p, [("I", "I", 3, 0)], [[b"abc"]])
    with pytest.raises(ValueError):
        dbf.read_header(p)
    with pytest.raises(ValueError):
        dbf.field_type("Z", 0)
    cells = lambda b: np.frombuffer(b, dtype=np.uint8).reshape(1, -1)
    with pytest.raises(ValueError):
        dbf.decode_column("L", 0, cells(b"!"))
    with pytest.raises(ValueError):
        dbf.decode_column("D", 0, cells(b"NotIso!!"))
    for raw, want in [(b"", None), (b" ", None), (b"1", 1), (b"-99", -99), (b"3.14", 3.14), (b"0.01**", 0.01), (b"******", None)]:
        got = dbf.decode_column("N", 2, cells(raw.ljust(8))).to_pylist()[0]
        assert got == want


def test_delimited(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_text("a\tb\n1\t2.5\n3\t\n")
    schema = "a int, b double"
    from pyspark.sql.types import _parse_datatype_string as parse
    df = delimited.read_delimited(spark, str(p), parse(schema))
    assert [tuple(r) for r in df.collect()] == [(1, 2.5), (3, None)]
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        delimited.read_delimited(spark, str(tmp_path / "empty.csv"), parse(schema))
    (tmp_path / "w.dat").write_text("1 0.5\n2 0.25\n")
    assert delimited.read_dat(spark, str(tmp_path / "w.dat"), parse(schema)).count() == 2
    assert delimited.repair_header(["", "b"]) == ["FIELD0", "b"]
    (tmp_path / "m.csv").write_text(",b\n1,2\n3\n4,5,6\n")
    names = delimited.header_names(spark, str(tmp_path / "m.csv"))
    assert names == ["FIELD0", "b"]
    rep = delimited.malformed_report(spark, str(tmp_path / "m.csv"), names).first()
    assert (rep.n_rows, rep.n_malformed) == (3, 2)
    (tmp_path / "fb.tsv").write_text("a\n7\n")
    df = delimited.load_with_fallback(spark, str(tmp_path / "none.csv"), str(tmp_path / "fb.tsv"), parse(schema), ["a"], ["b"])
    assert [tuple(r) for r in df.collect()] == [(7, 0.0)]


def test_gtfs_reader(spark, tmp_path):
    for ag in ("X", "Y"):
        d = tmp_path / ag
        d.mkdir()
        (d / "routes.txt").write_text("route_id,agency_id,extra,route_long_name\n1,a,z,Main\n")
        (d / "trips.txt").write_text("route_id,trip_id,direction_id,service_id,shape_id\n1,t1,0,wk,s1\n")
        (d / "stop_times.txt").write_text("trip_id,departure_time,stop_id,stop_sequence\nt1,25:10:00,s,1\n")
        (d / "calendar.txt").write_text("service_id,monday,saturday,sunday\nwk,1,0,0\n")
    (tmp_path / "spec.csv").write_text("agency,route_file,trip_file,stop_time_file,calendar_file\n" + "".join(
        f"{a},routes.txt,trips.txt,stop_times.txt,calendar.txt\n" for a in ("X", "Y")))
    spec = gtfs.read_spec(spark, str(tmp_path / "spec.csv"))
    t = gtfs.read_gtfs(spark, str(tmp_path), spec)
    ev = gtfs.stop_events(t)
    assert ev.count() == 2 and {r.agency for r in ev.collect()} == {"X", "Y"}


def test_scenarios(spark, tmp_path):
    base = scratch_path(spark, "scen")
    df = spark.range(10).withColumnRenamed("id", "parcelid")
    for kind in ("raw", "combined"):
        for sid in (1, 2, 3):
            sinks.publish_scenario(df.withColumn("v", F.lit(sid)), f"{base}/{kind}", 2020, sid, "lu")
    sinks.publish_scenario(df.limit(4).withColumn("v", F.lit(1)), f"{base}/raw", 2020, 1, "lu")
    assert spark.read.parquet(f"{base}/raw").count() == 24
    for sid, shared in ((1, 0), (2, 1), (3, 0)):
        sinks.scenario_log_append(spark, f"{base}/log", scenario_year=2020, scenario_code=sid, shared_externally=shared)
    log = sinks.read_log(spark, f"{base}/log")
    assert sinks.is_shared(log, 2020, 2) and not sinks.is_shared(log, 2020, 1)
    gone = sinks.retire_scenarios(spark, {k: f"{base}/{k}" for k in ("raw", "combined")}, f"{base}/log", f"{base}/log2", [(2020, 1), (2020, 2)])
    assert gone == [(2020, 1)]
    assert {r.scenario_id for r in spark.read.parquet(f"{base}/raw").select("scenario_id").distinct().collect()} == {2, 3}
    assert spark.read.parquet(f"{base}/combined").count() == 30
    st = {r.scenario_code: r.table_status for r in sinks.read_log(spark, f"{base}/log2").collect()}
    assert st == {1: sinks.STATUS_KEPT, 2: "created", 3: "created"}


def test_manifest_and_ledger(spark, tmp_path):
    import os
    from parcelflow.plans import catalog
    for r, (a, z) in {"r1": (1000, 2000), "r2": (1500, 1800)}.items():
        d = tmp_path / r
        d.mkdir()
        for n, t in {"gapstats.txt": a, "ixxi_taz.csv": z, "in.net": 500, "late.csv": a + 10, "2035_daynet.net": z + 5,
                     f"own_{r}.txt": 400}.items():
            (d / n).write_text("x")
            os.utime(d / n, (t, t))
    files = manifest.list_run_files(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")])
    m = catalog.run_manifest(files, ["daynet.net"])
    got = {(r.folder.rsplit("/", 1)[1], r.file_version.split("---")[0]) for r in m.collect()}
    assert got == {("r1", "in"), ("r1", "2035_daynet"), ("r1", "own_r1"), ("r2", "in"), ("r2", "2035_daynet"), ("r2", "own_r2")}
    one = [r.file_version for r in m.where(F.col("file_version").startswith("in---")).collect()]
    assert set(one) == {"in---Thu Jan 01 1970 00-08-20 .net"}
    diff = catalog.compare_runs(m, str(tmp_path / "r1"), str(tmp_path / "r2"))
    assert {r.file_version.split("---")[0] for r in diff.collect()} == {"2035_daynet", "own_r1", "own_r2"}
    led = scratch_path(spark, "ledger")
    sinks.ledger_append(m.where(F.col("folder").endswith("r1")), led)
    sinks.ledger_append(m, led)
    assert spark.read.parquet(led).count() == 6
    plan = {r.target_file for r in catalog.rebuild_plan(m, str(tmp_path / "r1"), "L", "D").collect()}
    assert plan == {"D/in.net", "D/2035_daynet.net", "D/own_r1.txt"}


def test_publish_guarded(spark, tmp_path):
    """A shared scenario, a failed write and a second writer change nothing."""
    from parcelflow.sources import sinks
    path, log = f"{tmp_path}/data", f"{tmp_path}/log"
    frame = lambda v: spark.createDataFrame([(v,)], "v int")
    read = lambda: sorted((r.scenario_id, r.v) for r in spark.read.parquet(path).collect())
    sinks.publish_guarded(frame(1), path, log, 2020, 1, "base")
    sinks.publish_guarded(frame(2), path, log, 2020, 2, "base", shared_externally=1)
    sinks.publish_guarded(frame(3), path, log, 2020, 1, "base")
    assert read() == [(1, 3), (2, 2)] and sinks.read_log(spark, log).count() == 3
    with pytest.raises(sinks.PublishRefused, match="shared"):
        sinks.publish_guarded(frame(4), path, log, 2020, 2, "base")
    failing = frame(5).selectExpr("raise_error('no') AS v")
    with pytest.raises(Exception, match="no"):
        sinks.publish_guarded(failing, path, log, 2020, 1, "base")
    p, fs = sinks._file_system(spark, f"{path}/_locks/scenario_year=2020-scenario_id=1-lu_scenario=base")
    assert not fs.exists(p) and sinks._create(fs, p)  # another writer
    with pytest.raises(sinks.PublishRefused, match="being written"):
        sinks.publish_guarded(frame(6), path, log, 2020, 1, "base")
    fs.delete(p, False)
    assert read() == [(1, 3), (2, 2)] and sinks.read_log(spark, log).count() == 3
    assert not list((tmp_path / "data/_staging").iterdir()) and not list((tmp_path / "data/_replaced").iterdir())

    class Shares:  # the scenario gets shared while it is written
        def __init__(self, df):
            self.df, self.sparkSession = df, df.sparkSession

        @property
        def write(self):
            sinks.scenario_log_append(spark, log, scenario_year=2020, scenario_code=1, shared_externally=1)
            return self.df.write
    with pytest.raises(sinks.PublishRefused, match="shared"):
        sinks.publish_guarded(Shares(frame(7)), path, log, 2020, 1, "base")
    assert read() == [(1, 3), (2, 2)]


def test_ordered_sink(spark, tmp_path):
    from parcelflow.sources import sinks
    rows = [(None if i % 9 == 0 else f"k{i * 7919 % 500:03d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(5)
    sinks.write_ordered(df, ["k", "i"], f"{tmp_path}/o", parts=6)
    got = sinks.read_ordered(spark, f"{tmp_path}/o", ["k", "i"]).orderBy("row_number").collect()
    assert [(r.k, r.i) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])) and [r.row_number for r in got] == list(range(1, 3001))
    assert spark.read.parquet(f"{tmp_path}/o").select("__part").distinct().count() >= 5
    for change in ("__part", "__row"):
        path = f"{tmp_path}/{change}"
        spark.read.parquet(f"{tmp_path}/o").withColumn(change, -F.col(change)).write.parquet(path)
        with pytest.raises(sinks.OutOfOrder):
            sinks.read_ordered(spark, path, ["k", "i"])
    sinks.write_ordered(df.limit(0), ["k"], f"{tmp_path}/e")
    assert sinks.read_ordered(spark, f"{tmp_path}/e", ["k"]).count() == 0


def test_gtfs_rejects(spark, tmp_path):
    from parcelflow.sources import gtfs
    (tmp_path / "A").mkdir()
    lines = ["service_id,monday,saturday,sunday", "S1,1,0,0", "S2,one,0,0", "", "S3,1,0", '"S,4",0,,1', "S5,0,1,9,9", "S6,1,x,y"]
    (tmp_path / "A/c.txt").write_text("\n".join(lines) + "\n")
    tables, rejects = gtfs.read_gtfs_checked(spark, str(tmp_path), {"A": {"calendar": "c.txt"}})
    assert [tuple(r) for r in tables["calendar"].orderBy("service_id").collect()] == [("A", "S,4", 0, None, 1), ("A", "S1", 1, 0, 0)]
    got = [(r.line, r.reason, r.file.rsplit("/", 1)[1], r.table) for r in rejects.orderBy("line").collect()]
    assert got == [(3, "monday is no int: one", "c.txt", "calendar"), (5, "not 4 fields", "c.txt", "calendar"), (7, "not 4 fields", "c.txt", "calendar"),
                   (8, "saturday is no int: x", "c.txt", "calendar")]
    many = [f"T{i},{i % 3},0,0" if i != 40_000 else "T40000,bad,0,0" for i in range(60_000)]
    (tmp_path / "A/m.txt").write_text("\n".join([lines[0], *many]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")  # the file is many splits
    try:
        tables, rejects = gtfs.read_gtfs_checked(spark, str(tmp_path), {"A": {"calendar": "m.txt"}})
        assert [(r.line, r.reason) for r in rejects.collect()] == [(40_002, "monday is no int: bad")] and tables["calendar"].count() == 59_999
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_read_dbf_in_two_passes(spark, tmp_path):
    """Three split sizes give equal rows; ends at early marks, decimals in whole-number fields, deleted records, several files."""
    folder = tmp_path / "many"
    folder.mkdir()
    rows = lambda k, n: [[str(k * 1000 + i).rjust(6).encode(), (f"{i / 4:6.2f}" if k == 1 else f"{i:6d}").encode()] for i in range(n)]
    fields = [("ID", "N", 6, 0), ("V", "N", 6, 0)]
    for k, n in ((0, 50), (1, 41), (2, 0), (3, 30)):
        write_dbf(str(folder / f"f{k}.dbf"), fields, rows(k, n), deleted=(3,) if n else ())
    data = bytearray((folder / "f3.dbf").read_bytes())
    at = 33 + 32 * 2
    data[at + 13 * 12] = 0x1A  # the twelfth record ends the file; behind it are decimals that don't count
    data[at + 13 * 20 + 7:at + 13 * 20 + 13] = b"  1.25"
    data[at + 13 * 25] = 0x1A
    (folder / "f3.dbf").write_bytes(bytes(data))
    want = sorted((k * 1000 + i, i / 4 if k == 1 else float(i)) for k, n in ((0, 50), (1, 41), (3, 12)) for i in range(n) if i != 3)
    for size in (7, 20, 1_000_000):
        df = dbf.read_dbf(spark, str(folder), size)
        assert sorted(map(tuple, df.collect())) == want and dict(df.dtypes) == {"ID": "bigint", "V": "double"}
    only = dbf.read_dbf(spark, str(folder / "f3.dbf"), 5, columns="V")
    assert sorted(r.V for r in only.collect()) == [i for i in range(12) if i != 3] and dict(only.dtypes) == {"V": "bigint"}
    import unittest.mock
    reader = dbf.DbfReader(only.schema, {"ends": "{}", "records_per_partition": "5"}, str(folder / "f3.dbf"))
    with unittest.mock.patch.object(dbf, "records_before_mark", side_effect=AssertionError):  # no sequential look while planning
        assert len(reader.partitions()) == 6


def test_dbf_writer_holds_one_file_at_a_time(tmp_path):
    """A partition of any size goes out in files of a bounded number of records, each while the rows come in."""
    import pandas as pd
    from checks import dbf_files
    drawn = []

    def batches():
        for i in range(6):
            drawn.append(i)
            yield pd.DataFrame({"record": [f" {i * 100_000 + j:8d}" for j in range(100_000)]})
    out = dbf_files._writer([("ID", "N", 8, 0)], str(tmp_path / "d"))(batches())
    first = next(out)
    assert first["n"][0] == dbf_files.FILE_RECORDS and len(drawn) < 6
    rest = [x for x in out]
    assert sum(x["n"][0] for x in rest) + first["n"][0] == 600_000 and len(list((tmp_path / "d").glob("*.dbf"))) == 3
    empty = list(dbf_files._writer([("ID", "N", 8, 0)], str(tmp_path / "e"))(iter([])))
    assert [x["n"][0] for x in empty] == [0]


def test_stop_times_meet_trips_in_all_tasks(spark, tmp_path):
    """Partitions of the large joins of a feed are not put together by their size, as a task holds what it reads."""
    from checks.domain import view
    spark.range(50).selectExpr("id AS o_orderkey", "id * 7 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(200).selectExpr("id % 60 AS l_orderkey", "CAST(id % 4 AS INT) AS l_linenumber", "id AS l_partkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    times = view(spark, str(tmp_path), "g_stop_times")
    least = {}
    for i in range(200):
        key = (i % 60, i % 4)
        if key[0] < 50:
            least[key] = min(least.get(key, i), i)
    assert {(r.trip_id, r.stop_sequence): r.stop_id for r in times.collect()} == least and times.count() == len(least)
    assert times.rdd.getNumPartitions() == tasks
    feed = {"routes": spark.sql("SELECT 'a' AS agency, 'r' AS route_id"), "trips": spark.range(9).selectExpr("'a' AS agency", "'r' AS route_id", "id AS trip_id", "'s' AS service_id"),
            "stop_times": spark.range(27).selectExpr("'a' AS agency", "id % 9 AS trip_id", "id AS stop_id"), "calendar": spark.sql("SELECT 'a' AS agency, 's' AS service_id, 1 AS monday")}
    events = gtfs.stop_events(feed)
    assert events.count() == 27 and events.rdd.getNumPartitions() >= tasks
