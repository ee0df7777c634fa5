"""Sources, sinks, scenario tables, run catalogue and their checks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.dbf_files import write_dbf
from checks.domain import VIEWS, table, view, with_views
from checks.registry import query, r
from parcelflow.functions import scalars as S
from parcelflow.operators import aggregates as A
from parcelflow.operators import joins as J
from parcelflow.plans import catalog as C
from parcelflow.plans import themes
from parcelflow.session import scratch_path
from parcelflow.sources import delimited, gtfs, manifest, raw_tables, sinks
from parcelflow.sources.dbf import read_dbf, register_dbf

CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                         T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType())])
CUSTOMER_SQL = f"SELECT c_custkey, c_name, c_nationkey, {r('c_acctbal')} AS c_acctbal FROM customer"


def _customer(spark, sf):
    return table(spark, sf, "customer").select(*CUSTOMER.fieldNames())


@query("read_delimited_tsv", CUSTOMER_SQL)
def _tsv(spark, sf):
    path = scratch_path(spark, "customer") + ".tsv"
    _customer(spark, sf).write.csv(path, sep="\t", header=True)
    return delimited.read_delimited(spark, path, CUSTOMER)


@query("write_csv", CUSTOMER_SQL)
def _csv(spark, sf):
    path = scratch_path(spark, "customer") + ".csv"
    sinks.write_csv(_customer(spark, sf), path)
    return delimited.read_delimited(spark, path, CUSTOMER)


@query("read_dat", with_views(f"SELECT TAZ, {r('IXWkrFraxn')} AS IXWkrFraxn, {r('extWkrfraxn')} AS extWkrfraxn FROM raw_ixworker", "raw_ixworker"))
def _dat(spark, sf):
    path = scratch_path(spark, "worker") + ".dat"
    view(spark, sf, "raw_ixworker").write.csv(path, sep=" ", header=False)
    schema = T.StructType([T.StructField("TAZ", T.LongType()), T.StructField("IXWkrFraxn", T.DoubleType()), T.StructField("extWkrfraxn", T.DoubleType())])
    return delimited.read_dat(spark, path, schema)


@query("write_table", CUSTOMER_SQL)
def _table(spark, sf):
    path = scratch_path(spark, "table")
    sinks.write_table(_customer(spark, sf).limit(1), path)
    sinks.write_table(_customer(spark, sf), path)
    return spark.read.parquet(path)


@query("dbf_round_trip", f"SELECT l_orderkey AS ORDERKEY, l_linenumber::BIGINT AS LINENUM, {r('l_extendedprice')} AS PRICE, l_returnflag AS FLAG FROM lineitem")
def _dbf(spark, sf):
    path = scratch_path(spark, "lineitem") + ".dbf"
    src = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ORDERKEY", "l_linenumber AS LINENUM", "l_extendedprice AS PRICE", "l_returnflag AS FLAG")
    write_dbf(src, [("ORDERKEY", "N", 12, 0), ("LINENUM", "N", 4, 0), ("PRICE", "N", 14, 2), ("FLAG", "C", 3, 0)], path)
    register_dbf(spark)
    return spark.read.format("dbf").option("records_per_partition", 20000).load(path)


@query("dbf_two_passes", f"SELECT l_orderkey AS ORDERKEY, {r('l_extendedprice')} AS PRICE, {r('l_quantity')} AS QUANTITY FROM lineitem")
def _dbf_two_passes(spark, sf):
    """The price stands in a field declared without decimals."""
    path = scratch_path(spark, "lineitem") + ".dbf"
    src = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ORDERKEY", "lpad(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS STRING), 14, ' ') AS PRICE", "l_quantity AS QUANTITY")
    write_dbf(src, [("ORDERKEY", "N", 12, 0), ("PRICE", "C", 14, 0), ("QUANTITY", "N", 10, 0)], path, kinds={"PRICE": "N"})
    return read_dbf(spark, path, 5000).withColumn("QUANTITY", F.col("QUANTITY").cast("double"))


@query("dbf_topline", f"SELECT {r('sum(l_extendedprice)')} AS SUM_PRICE FROM lineitem")
def _dbf_topline(spark, sf):
    path = scratch_path(spark, "lineitem") + ".dbf"
    src = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ORDERKEY", "l_extendedprice AS PRICE")
    write_dbf(src, [("ORDERKEY", "N", 12, 0), ("PRICE", "N", 14, 2)], path)
    register_dbf(spark)
    return A.topline(spark.read.format("dbf").option("columns", "PRICE").load(path), ["PRICE"])


@query("load_raw_household", with_views("""SELECT hhno, hhsize, hhvehs, hhincome, hrestype, hhparcel FROM raw_hh""", "raw_hh"))
def _load_hh(spark, sf):
    run = scratch_path(spark, "run")
    have = VIEWS["raw_hh"][1]
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in raw_tables.RAW_SCHEMAS["raw_hh"].fields]
    view(spark, sf, "raw_hh").select(*cols).write.csv(f"{run}/_household.tsv", sep="\t", header=True)
    hh = raw_tables.load_raw(spark, run, 2020, ["raw_hh"])["raw_hh"]
    return hh.select(*[F.col(c).cast("bigint").alias(c) for c in have])


CV_NAMES = [f"C{a}_{m}_I" for a in (2, 3) for m in ("VT", "VHT", "VMT", "CVMT")]


@query("load_raw_vehicles", with_views("SELECT CAST(I AS BIGINT) AS I, " + ", ".join(f"{r(f'round({c}, 1)')} AS {c}" for c in CV_NAMES) + " FROM raw_cveh", "raw_cveh"))
def _load_cv(spark, sf):
    run = scratch_path(spark, "run")
    write_dbf(view(spark, sf, "raw_cveh"), [("I", "N", 8, 0), *[(c, "N", 16, 1) for c in CV_NAMES]], f"{run}/cveh_taz.dbf")
    cv = raw_tables.load_raw(spark, run, 2020, ["raw_cveh"])["raw_cveh"]
    return cv.select(F.col("I").cast("bigint").alias("I"), *[F.round(F.col(c).cast("double"), 1).alias(c) for c in CV_NAMES])


def _fitting(kind: str) -> dict[str, str]:
    """A raw table's derived columns, brought into the range of their published types."""
    fit = {"int": "({}) % 2000000000", "smallint": "({}) % 30000", "float": "CAST(floor({}) AS BIGINT) % 1000"}
    return {f.name: fit[f.dataType.simpleString()].format(f.name) for f in raw_tables.RAW_SCHEMAS[kind].fields if f.name in VIEWS[kind][1]}


RAW_SUMS = " UNION ALL ".join(f"SELECT '{k}' AS kind, '{c}' AS name, count({c}) AS n, CAST(sum({e}) AS DOUBLE) AS total FROM {k}"
                              for k in raw_tables.RAW_SCHEMAS for c, e in _fitting(k).items())


@query("load_raw_kinds", with_views(f"SELECT kind, name, n, {r('total')} AS total FROM ({RAW_SUMS}) q", *raw_tables.RAW_SCHEMAS))
def _load_kinds(spark, sf):
    """All nine kinds of raw tables, written as the files of one run folder and loaded."""
    run = scratch_path(spark, "run")
    for kind, schema in raw_tables.RAW_SCHEMAS.items():
        own = view(spark, sf, kind).selectExpr(*[f"{e} AS {c}" for c, e in _fitting(kind).items()])
        path = f"{run}/{raw_tables.RAW_FILES[kind].format(year=2020)}"
        if path.endswith(".dbf"):
            write_dbf(own, [(c, "N", 16, 0) for c in own.columns], path)
            continue
        cols = own.select(*[F.col(f.name) if f.name in own.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        text = path.rsplit(".", 1)[-1]
        cols.write.csv(path, sep=delimited.SEPARATORS.get(text, " "), header=text != "dat")
    loaded = raw_tables.load_raw(spark, run, 2020)
    sums = []
    for kind, df in loaded.items():
        have = list(_fitting(kind))
        one = df.agg(*[F.count(c).alias(f"n_{c}") for c in have], *[F.sum(F.col(c).cast("double")).alias(f"t_{c}") for c in have])
        each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n_{c}").alias("n"), F.col(f"t_{c}").alias("total")) for c in have])
        sums.append(one.select(F.lit(kind).alias("kind"), F.inline(each)))
    return J.union_all(sums)


@query("load_with_fallback", "SELECT o_orderkey, o_custkey, CAST(0 AS DOUBLE) AS distau FROM orders")
def _fallback(spark, sf):
    base = scratch_path(spark, "fallback")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.csv(f"{base}.tsv", sep="\t", header=True)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("distau", T.DoubleType())])
    return delimited.load_with_fallback(spark, f"{base}-missing.csv", f"{base}.tsv", schema, ["o_orderkey", "o_custkey"], ["distau"])


@query("malformed_report", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS n_malformed FROM orders")
def _malformed(spark, sf):
    path = scratch_path(spark, "malformed") + ".csv"
    extra = F.when(F.col("o_orderkey") % 7 == 0, F.lit(",surplus")).otherwise(F.lit(""))
    table(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(","), "o_orderstatus", extra).alias("value")).write.text(path)
    names = delimited.repair_header(["", "status"])
    # parts without a header line of their own
    rep = delimited.malformed_report(spark, path, names, header=False)
    return rep.select("n_rows", "n_malformed")


# ------------------------------------------------------------------ scenario tables

@query("publish_scenario", "SELECT c_custkey, c_nationkey % 3 AS scenario_id, CASE WHEN c_nationkey % 3 = 1 THEN 2 ELSE 1 END AS edition FROM customer")
def _publish(spark, sf):
    path = scratch_path(spark, "scenarios")
    c = table(spark, sf, "customer")
    for edition, ids in ((1, (0, 1, 2)), (2, (1,))):
        for i in ids:
            part = c.where(F.col("c_nationkey") % 3 == i).select("c_custkey", F.lit(edition).alias("edition"))
            sinks.publish_scenario(part, path, 2020, i, "base")
    return spark.read.parquet(path).select("c_custkey", "scenario_id", "edition")


def _with_log(spark, sf):
    base = scratch_path(spark, "retire")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for name in ("raw", "combined"):
        for i, st in enumerate(("F", "O", "P")):
            sinks.publish_scenario(o.where(F.col("o_orderstatus") == st), f"{base}/{name}", 2020, i, "base")
    for i in range(3):
        sinks.scenario_log_append(spark, f"{base}/log", scenario_year=2020, scenario_code=i, shared_externally=int(i == 1), scenario_desc=f"s{i}")
    return base


@query("retire_scenarios", """SELECT 'raw' AS tbl, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2
   UNION ALL SELECT 'combined', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def _retire(spark, sf):
    base = _with_log(spark, sf)
    sinks.retire_scenarios(spark, {t: f"{base}/{t}" for t in ("raw", "combined")}, f"{base}/log", f"{base}/log_new", [(2020, 0), (2020, 1)])
    one = lambda t: spark.read.parquet(f"{base}/{t}").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(t))
    return one("raw").unionByName(one("combined"))


@query("scenario_log_status", """SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS scenario_code,
   CASE o_orderstatus WHEN 'F' THEN 'deleted all tables' ELSE 'created' END AS table_status, o_orderstatus = 'O' AS shared FROM orders""")
def _log(spark, sf):
    base = _with_log(spark, sf)
    sinks.retire_scenarios(spark, {"raw": f"{base}/raw"}, f"{base}/log", f"{base}/log_new", [(2020, 0), (2020, 1)], keep_combined=False)
    log = sinks.read_log(spark, f"{base}/log_new")
    shared = sinks.shared_scenarios(log).select("scenario_code", F.lit(True).alias("shared"))
    return log.join(shared, "scenario_code", "left").select("scenario_code", "table_status", F.coalesce("shared", F.lit(False)).alias("shared"))


@query("publish_guarded", """SELECT c_custkey, c_nationkey % 3 AS scenario_id, CASE WHEN c_nationkey % 3 = 1 THEN 2 ELSE 1 END AS edition FROM customer""")
def _guarded(spark, sf):
    """Scenario 0 is shared after its first edition, so only scenario 1 gets a second one."""
    base = scratch_path(spark, "guarded")
    c = table(spark, sf, "customer")
    for edition, ids in ((1, (0, 1, 2)), (2, (0, 1))):
        for i in ids:
            part = c.where(F.col("c_nationkey") % 3 == i).select("c_custkey", F.lit(edition).alias("edition"))
            try:
                sinks.publish_guarded(part, f"{base}/data", f"{base}/log", 2020, i, "base", shared_externally=int(i == 0))
            except sinks.PublishRefused:
                assert (i, edition) == (0, 2)
    return spark.read.parquet(f"{base}/data").select("c_custkey", "scenario_id", "edition")


@query("ordered_sink", "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority, o_custkey, o_orderkey) AS row_number FROM orders")
def _ordered(spark, sf):
    path, order = scratch_path(spark, "ordered"), ["o_orderpriority", "o_custkey", "o_orderkey"]
    sinks.write_ordered(table(spark, sf, "orders").select(*order), order, path, parts=7)
    return sinks.read_ordered(spark, path, order).select("o_orderkey", "o_orderpriority", "row_number")


# ------------------------------------------------------------------ run catalogue

VIEWS["run_files"] = ("events", {
    "folder": "concat('run', user_id)", "modified": "ts",
    "name": "CASE event_type WHEN 'signup' THEN 'gapstats' WHEN 'purchase' THEN 'ixxi_taz' WHEN 'error' THEN concat('2035_daynet', event_id % 3) ELSE concat(event_type, event_id % 40) END",
    "ext": "CASE event_type WHEN 'signup' THEN '.txt' WHEN 'purchase' THEN '.csv' WHEN 'error' THEN '.net' ELSE '.dbf' END"})
VERSION = "concat(name, '---', strftime(modified, '%a %b %d %Y %H-%M-%S '), ext)"
MANIFEST = f"""tm AS (SELECT folder, coalesce(min(floor(epoch(modified))) FILTER (WHERE concat(name, ext) IN ('gapstats.txt', 'timelog.start.txt')), 0) AS a,
     coalesce(min(floor(epoch(modified))) FILTER (WHERE concat(name, ext) IN ('ixxi_taz.csv', 'cveh_taz.csv')), 2000000000) AS z FROM run_files GROUP BY 1),
   mf AS (SELECT f.folder, {VERSION} AS file_version FROM run_files f JOIN tm ON tm.folder = f.folder
     WHERE floor(epoch(modified)) < a OR (epoch(modified) > z AND name LIKE '%daynet%' AND ext = '.net'))"""


def _manifest(spark, sf):
    return C.run_manifest(view(spark, sf, "run_files"), ["daynet.net"])


@query("run_manifest", with_views(f"WITH {MANIFEST} SELECT * FROM mf", "run_files"))
def _run_manifest(spark, sf):
    return _manifest(spark, sf)


@query("supporting_manifest", with_views(f"SELECT folder, {VERSION} AS file_version FROM run_files", "run_files"))
def _supporting(spark, sf):
    return C.run_manifest(view(spark, sf, "run_files"), supporting=True)


@query("unique_versions", with_views(f"WITH {MANIFEST} SELECT DISTINCT file_version FROM mf", "run_files"))
def _unique(spark, sf):
    return C.unique_versions(_manifest(spark, sf))


@query("compare_runs", with_views(f"""WITH {MANIFEST}, a AS (SELECT file_version FROM mf WHERE folder = 'run3'), b AS (SELECT file_version FROM mf WHERE folder = 'run8')
   SELECT split_part(file_version, '.', 1) AS file_version, 'run3' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x
   UNION ALL SELECT split_part(file_version, '.', 1), 'run8' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y""", "run_files"))
def _compare(spark, sf):
    return C.compare_runs(_manifest(spark, sf), "run3", "run8")


@query("rebuild_plan", with_views(f"""WITH {MANIFEST} SELECT concat('store/', file_version) AS source_file, concat('new/', split_part(file_version, '---', 1),
   '.', split_part(file_version, '.', -1)) AS target_file FROM mf WHERE folder = 'run5'""", "run_files"))
def _rebuild(spark, sf):
    return C.rebuild_plan(_manifest(spark, sf), "run5", "store", "new")


@query("ledger_append", with_views(f"WITH {MANIFEST} SELECT folder, file_version FROM mf", "run_files"))
def _ledger(spark, sf):
    path, m = scratch_path(spark, "ledger"), _manifest(spark, sf)
    sinks.ledger_append(m.where(F.col("folder") < "run5"), path)
    sinks.ledger_append(m, path)
    return spark.read.parquet(path)


@query("list_run_files", """SELECT concat('run=run', o_orderstatus) AS folder, '.txt' AS ext, CAST(1 AS BIGINT) AS n_files, CAST(sum(length(CAST(o_orderkey AS VARCHAR)) + 1) AS BIGINT) AS length
   FROM orders GROUP BY 1""")
def _list(spark, sf):
    """One file per folder, listed with its length."""
    base = scratch_path(spark, "runs")
    parts = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value"), F.concat(F.lit("run"), "o_orderstatus").alias("run"))
    parts.repartition("run").write.partitionBy("run").text(base)
    files = manifest.list_run_files(spark, [f"{base}/run=run{s}" for s in "FOP"])
    return files.groupBy(F.substring_index("folder", "/", -1).alias("folder"), "ext").agg(F.count("name").alias("n_files"), F.sum("length").alias("length"))


@query("read_gtfs", with_views("""SELECT r.agency, r.route_id, count(*) AS n_events, count(s.stop_id) AS n_stops, min(s.departure_time) AS first_departure, max(c.monday) AS monday
   FROM g_routes r LEFT JOIN g_trips t ON t.agency = r.agency AND t.route_id = r.route_id LEFT JOIN g_stop_times s ON s.agency = t.agency AND s.trip_id = t.trip_id
   LEFT JOIN g_calendar c ON c.agency = t.agency AND c.service_id = t.service_id GROUP BY 1, 2""", "g_routes", "g_trips", "g_stop_times", "g_calendar"))
def _read_gtfs(spark, sf):
    base = scratch_path(spark, "gtfs")
    files = {"routes": "g_routes", "trips": "g_trips", "stop_times": "g_stop_times", "calendar": "g_calendar"}
    for t, v in files.items():
        view(spark, sf, v).write.partitionBy("agency").csv(f"{base}/{t}", header=True)
    spec = {f"AG{i}": {t: f"../{t}/agency=AG{i}" for t in files} for i in range(5)}
    ev = gtfs.stop_events(gtfs.read_gtfs(spark, base, spec))
    return ev.groupBy("agency", "route_id").agg(F.count(F.lit(1)).alias("n_events"), F.count("stop_id").alias("n_stops"),
                                                F.min("departure_time").alias("first_departure"), F.max("monday").alias("monday"))


BROKEN = """SELECT agency, trip_id, CASE WHEN trip_id % 7 = 0 THEN 'x' || stop_sequence WHEN trip_id % 11 = 0 THEN '' ELSE CAST(stop_sequence AS VARCHAR(9)) END AS stop_sequence,
   CAST(stop_id AS VARCHAR(9)) || CASE WHEN trip_id % 13 = 0 THEN ',more' ELSE '' END AS stop_id, departure_time FROM g_stop_times"""


@query("read_gtfs_rejects", with_views(f"""SELECT agency, CASE WHEN trip_id % 13 = 0 THEN 'not 4 fields' WHEN trip_id % 7 = 0 THEN 'stop_sequence is no int' ELSE 'read' END AS reason,
   count(*) AS n, count(CASE WHEN trip_id % 13 <> 0 AND trip_id % 7 <> 0 AND trip_id % 11 <> 0 THEN stop_sequence END) AS n_sequences FROM g_stop_times GROUP BY 1, 2""", "g_stop_times"))
def _rejects(spark, sf):
    """Stop times with letters in a number, empty numbers and too many fields."""
    base = scratch_path(spark, "gtfs")
    broken = spark.sql(BROKEN.replace("FROM g_stop_times", "FROM {t}"), t=view(spark, sf, "g_stop_times"))
    text = broken.select("agency", F.concat_ws(",", F.col("trip_id").cast("string"), F.coalesce("stop_sequence", F.lit("")), F.col("stop_id"),
                                               F.coalesce("departure_time", F.lit(""))).alias("trip_id,stop_sequence,stop_id,departure_time"))
    text.write.partitionBy("agency").option("quote", "").csv(f"{base}/stop_times", header=True)
    spec = {f"AG{i}": {"stop_times": f"../stop_times/agency=AG{i}"} for i in range(5)}
    tables, rejects = gtfs.read_gtfs_checked(spark, base, spec)
    read = tables["stop_times"].groupBy("agency").agg(F.lit("read").alias("reason"), F.count(F.lit(1)).alias("n"), F.count("stop_sequence").alias("n_sequences"))
    lost = rejects.groupBy("agency", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("n_sequences"))
    return read.unionByName(lost)


@query("read_shapes", with_views(f"""SELECT agency, concat(agency, shape_id) AS shape_uid, count(*) AS n, {r('max(shape_pt_lat)')} AS top FROM g_shapes GROUP BY 1, 2""", "g_shapes"))
def _shapes(spark, sf):
    base = scratch_path(spark, "gtfs")
    view(spark, sf, "g_shapes").write.partitionBy("agency").csv(f"{base}/shapes", header=True)
    spec = {f"AG{i}": {"shapes": f"../shapes/agency=AG{i}"} for i in range(5)}
    s = gtfs.read_shapes(spark, base, spec)
    return s.groupBy("agency", "shape_uid").agg(F.count(F.lit(1)).alias("n"), F.max("shape_pt_lat").alias("top"))
