"""Network comparison, general operators and their checks."""

from pyspark.sql import functions as F

from checks.domain import PERIOD_HOURS, table, view, with_views
from checks.registry import query, r
from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators import aggregates as A
from parcelflow.operators import joins as J
from parcelflow.operators import profiles, windows
from parcelflow.plans import network as N

P = PERIOD_HOURS
_sum4 = lambda s: " + ".join(f"{p}{s}" for p in P)
_wt4 = lambda s: " + ".join(f"{p}{s} * {p}V" for p in P)


def util_sql(c, v):
    rules = [("5, 24", None, .85), ("2, 3, 4, 12, 22", .85, 1.1), ("1, 6, 16, 26", .9, 1.05), ("8, 9, 51, 56", .5, .85)]
    out = ""
    for cl, lo, hi in rules:
        out += (f" WHEN {c} IN ({cl}) THEN CASE WHEN {v} < {hi} THEN 2 WHEN {v} >= {hi} THEN 3 END" if lo is None else
                f" WHEN {c} IN ({cl}) THEN CASE WHEN {v} < {lo} THEN 1 WHEN {v} <= {hi} THEN 2 WHEN {v} > {hi} THEN 3 END")
    return f"CASE {out} ELSE 0 END"


def conglev_sql(a, p):
    mod = lambda x: f"({x} >= 0.9 AND {x} < 1.05)"
    return f"CASE WHEN {mod(a)} OR {mod(p)} THEN 2 WHEN {a} >= 1.05 OR {p} >= 1.05 THEN 3 ELSE 1 END"


def metrics_sql(net):
    return f"""(SELECT *, {util_sql('CAPCLASS', 'congmapvc')} AS rd_util FROM (SELECT *, concat(A, '_', B) AS A_B, trim(concat(SACTRAK, '__', PHASE2)) AS pjt_id,
        {_sum4('V')} AS V4h, {_sum4('VMT')} AS VMT4h, {_sum4('CVMT')} AS CVMT4h,
        CASE WHEN {_sum4('V')} <> 0 THEN ({_wt4('VC')}) / ({_sum4('V')}) ELSE 0 END AS VC4h,
        CASE WHEN {_sum4('V')} <> 0 THEN ({_wt4('SPDGRP')}) / ({_sum4('V')}) ELSE 0 END AS CSPD4h,
        greatest(A3VC, P3VC) AS congmapvc, CASE WHEN DAYVMT > 0 THEN DAYCVMT / DAYVMT ELSE 0 END AS cvmt_p,
        {conglev_sql('A3VC', 'P3VC')} AS conglev FROM {net}) q0)"""


METRICS = ["V4h", "VMT4h", "CVMT4h", "VC4h", "CSPD4h", "congmapvc", "cvmt_p"]


@query("link_metrics", with_views(f"""SELECT A_B, pjt_id, {', '.join(f'{r(m)} AS {m}' for m in METRICS)}, rd_util, conglev FROM {metrics_sql('net_base')} m""", "net_base"))
def _metrics(spark, sf):
    return N.link_metrics(view(spark, sf, "net_base")).select("A_B", "pjt_id", *METRICS, "rd_util", "conglev")


INTS = {"CAPCLASS", "BIKE", "rd_util", "conglev"}


def compare_sql():
    val = lambda a, c: f"{a}.{c}" if c in INTS else r(f"{a}.{c}")
    cols = [f"{val('f', c) if c == 'DISTANCE' else 'f.' + c} AS {c}" for c in N.DESCRIPTIVE]
    cols += [f"{val('b', c)} AS BY{c}" for c in N.COMPARED] + [f"{val('f', c)} AS FY{c}" for c in N.COMPARED]
    return f"""WITH j AS (SELECT f.A_B, {', '.join(cols)}, b.DYV AS bdyv, f.DYV AS fdyv, CASE WHEN b.DYV > 0 THEN f.DYV / b.DYV ELSE 0 END AS dr,
        CASE WHEN b.LANES > 0 THEN f.LANES / b.LANES ELSE 0 END AS lr, f.LANES - b.LANES AS dl, f.DYV - b.DYV AS dd, f.DAYVMT - b.DAYVMT AS dv,
        f.DAYCVMT - b.DAYCVMT AS dc, (b.conglev - 1) * 3 + f.conglev AS pr, f.A3VC AS fa, f.P3VC AS fp,
        CASE WHEN f.CAPCLASS < 99 AND b.CAPCLASS = 99 THEN 1 WHEN f.CAPCLASS = 99 AND b.CAPCLASS < 99 THEN 2 ELSE 0 END AS newroad,
        CASE WHEN f.LANES - b.LANES > 0 OR f.CAPCLASS <> b.CAPCLASS THEN 1 ELSE 0 END AS proj_IN
      FROM {metrics_sql('net_base')} b JOIN {metrics_sql('net_future')} f ON b.A_B = f.A_B),
    k AS (SELECT *, pr + CASE WHEN proj_IN = 1 AND newroad = 0 THEN 10 WHEN proj_IN = 1 AND newroad = 1 THEN 20 ELSE 0 END AS c0 FROM j)
    SELECT * EXCLUDE (bdyv, fdyv, dr, lr, dl, dd, dv, dc, pr, fa, fp, c0), {r('dr')} AS fybydyv_p, {r('lr')} AS fybylanes, {r('dl')} AS delta_lanes, {r('dd')} AS delta_day,
      {r('dv')} AS delta_dvmt, {r('dc')} AS delta_dcvmt, CASE WHEN SACTRAK <> ' ' OR PHASE2 <> ' ' THEN 1 ELSE 0 END AS proj,
      CASE WHEN c0 = 11 AND dr > 1.3 AND (fa > 0.5 OR fp > 0.5) THEN 10 WHEN c0 > 20 AND (fa > 0.7 OR fp > 0.7) THEN 20 ELSE c0 END AS phasing FROM k"""


@query("link_compare", with_views(compare_sql(), "net_base", "net_future"))
def _compare(spark, sf):
    return N.link_compare(view(spark, sf, "net_base"), view(spark, sf, "net_future"))


def project_sql():
    cols = [*N.PROJECT_SUMS, *N.PROJECT_MEANS]
    stats = ", ".join([f"coalesce(sum({c}), 0) AS s_{c}" for c in N.PROJECT_SUMS] + [
        f"sum({v} * {w}) / nullif(sum(CASE WHEN {v} IS NOT NULL THEN {w} ELSE 0 END), 0) AS s_{n}" for n, (v, w) in N.PROJECT_MEANS.items()])
    one = lambda net: f"(SELECT pjt_id, {stats} FROM {metrics_sql(net)} m GROUP BY pjt_id)"
    b, s = (lambda c: f"coalesce(b.s_{c}, 0)"), (lambda c: f"coalesce(s.s_{c}, 0)")
    out = ", ".join(f"{r(b(c))} AS BY{c}, {r(s(c))} AS SN{c}, {r(f'{s(c)} - {b(c)}')} AS dif{c}, {r(f'({s(c)} - {b(c)}) / nullif({b(c)}, 0)')} AS ptc{c}" for c in cols)
    return f"SELECT b.pjt_id, {out} FROM {one('net_base')} b JOIN {one('net_future')} s ON s.pjt_id = b.pjt_id"


@query("project_compare", with_views(project_sql(), "net_base", "net_future"))
def _projects(spark, sf):
    return N.project_compare(view(spark, sf, "net_base"), view(spark, sf, "net_future"))


def years_sql():
    cols = []
    for a in ("SPD", "CAPC", "LANE", "BIKE"):
        by = f"{a}16"
        cols.append("CAST(least(" + ", ".join(f"CASE WHEN {c} IS DISTINCT FROM {by} THEN {y} END" for c, y in (
            (f"{a}20", 2020), (f"{a}35", 2035), (f"{a}35_DPS", 2035), (f"{a}40_DPS", 2040))) + f") AS INT) AS {a}_changeyears")
    return f"SELECT A, B, SACTRAK, PHASE2, {', '.join(cols)} FROM yearly WHERE SACTRAK <> ''"


@query("attribute_change_years", with_views(years_sql(), "yearly"))
def _years(spark, sf):
    return N.attribute_change_years(view(spark, sf, "yearly"))


@query("attribute_names_unpivoted", with_views("""SELECT prefix, yr, count(*) AS n FROM (SELECT regexp_extract(col, '^[A-Za-z]*') AS prefix,
     CAST(regexp_extract(col, '[0-9]+') AS INT) + 2000 AS yr FROM (UNPIVOT (SELECT B, SPD16, SPD20, SPD35_DPS, BIKE40_DPS FROM yearly)
     ON SPD16, SPD20, SPD35_DPS, BIKE40_DPS INTO NAME col VALUE v) u WHERE v > 1) q GROUP BY 1, 2""", "yearly"))
def _names(spark, sf):
    cols = ["SPD16", "SPD20", "SPD35_DPS", "BIKE40_DPS"]
    long = view(spark, sf, "yearly").unpivot(["B"], cols, "col", "v").where("v > 1")
    return long.groupBy(S.attribute_prefix("col").alias("prefix"), S.attribute_year("col").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ general operators

@query("band_counts", "SELECT c.c_custkey, " + ", ".join(
    f"count(o.o_orderkey) FILTER (WHERE {p}) AS {n}" for n, p in (("b1", "o_totalprice < 100000"), ("b2", "o_totalprice >= 100000 AND o_totalprice < 300000"),
                                                                  ("b3", "o_totalprice >= 300000"))) +
       f", {r('coalesce(sum(o.o_totalprice) FILTER (WHERE o_orderstatus = ' + chr(39) + 'F' + chr(39) + '), 0)')} AS f_sum FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def _band_counts(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    band = S.band("o_totalprice", [100000, 300000])
    sums = o.groupBy("o_custkey").agg(*[A.count_if(band == i).alias(f"b{i}") for i in (1, 2, 3)],
                                      A.sum_if(F.col("o_orderstatus") == "F", "o_totalprice").alias("f_sum"))
    return J.keep_all(table(spark, sf, "customer").select("c_custkey"), sums, "c_custkey", "o_custkey", zero=["b1", "b2", "b3", "f_sum"])


@query("bands_right_closed", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 30 THEN 2 ELSE 3 END AS band FROM part")
def _bands_right(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.band("p_size", [10, 30], "right").alias("band"))


@query("conditional_sums", f"""SELECT l_suppkey, {r("coalesce(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 0)")} AS returned,
   {r("coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0)")} AS open_qty FROM lineitem GROUP BY 1""")
def _cond_sums(spark, sf):
    c = F.col
    return A.cond_sums(table(spark, sf, "lineitem"), ["l_suppkey"], {"returned": (c("l_returnflag") == "R", c("l_extendedprice")),
                                                                    "open_qty": (c("l_linestatus") == "O", c("l_quantity"))})


@query("weighted_average", f"""SELECT l_suppkey, {r('sum(l_discount * l_extendedprice) / sum(l_extendedprice)')} AS disc,
   {r('sum(l_tax * l_quantity) / sum(l_quantity)')} AS tax FROM lineitem GROUP BY 1""")
def _weighted(spark, sf):
    return A.weighted_average(table(spark, sf, "lineitem"), ["l_suppkey"], {"disc": ("l_discount", "l_extendedprice"), "tax": ("l_tax", "l_quantity")})


@query("allocate_share", f"""WITH z AS (SELECT c_nationkey AS k, sum(o_totalprice) AS t FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
   w AS (SELECT c_nationkey AS k, sum(abs(c_acctbal)) AS s FROM customer GROUP BY 1)
   SELECT c_custkey, {r('abs(c_acctbal) / w.s * z.t')} AS amount FROM customer JOIN z ON z.k = c_nationkey JOIN w ON w.k = c_nationkey""")
def _allocate(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    spent = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("t"))
    totals = c.join(spent, c.c_custkey == spent.o_custkey).groupBy("c_nationkey").agg(F.sum("t").alias("amount"))
    parts = c.select("c_custkey", "c_nationkey", F.abs("c_acctbal").alias("w"))
    return A.allocate_share(parts, totals, "c_nationkey", {"w": ("s", ["amount"])}).select("c_custkey", "amount")


@query("share_of_total", f"SELECT o_orderkey, {r('o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus) * 1000000')} AS ppm FROM orders")
def _share(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return A.share_of_total(o, ["o_orderstatus"], "o_totalprice", "s").select("o_orderkey", (F.col("s") * 1000000).alias("ppm"))


@query("rate_then_apply", f"""WITH a AS (SELECT n_regionkey AS rk, sum(s_acctbal) AS act FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1),
   u AS (SELECT c_custkey, n_regionkey AS rk, abs(c_acctbal) AS base FROM customer JOIN nation ON n_nationkey = c_nationkey),
   b AS (SELECT rk, sum(base) AS base FROM u GROUP BY 1)
   SELECT c_custkey, {r('CASE WHEN b.base > 0 THEN a.act / b.base ELSE 0 END * u.base')} AS applied FROM u LEFT JOIN a ON a.rk = u.rk LEFT JOIN b ON b.rk = u.rk""")
def _rates(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    u = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.abs("c_acctbal").alias("base")).join(n, "n_nationkey")
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_acctbal").alias("act")).join(n, "n_nationkey")
    return A.rate_then_apply(u, a, "n_regionkey", {"applied": ("act", "base")}).select("c_custkey", "applied")


@query("distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def _distinct(spark, sf):
    return A.distinct_count(table(spark, sf, "lineitem"), ["l_returnflag"], "l_partkey", "parts")


@query("joined_names", """SELECT n_regionkey, coalesce(string_agg(n_name, ';' ORDER BY n_name), '') AS all_names,
   coalesce(string_agg(n_name, ';' ORDER BY n_name) FILTER (WHERE s > 0), '') AS with_suppliers FROM
   (SELECT n_regionkey, n_name, count(s_suppkey) AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) q GROUP BY 1""")
def _joined(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("s"))
    j = n.join(s, n.n_nationkey == s.s_nationkey, "left")
    return j.groupBy("n_regionkey").agg(A.joined_names("n_name").alias("all_names"), A.joined_names("n_name", F.col("s") > 0).alias("with_suppliers"))


@query("only_in_each", """WITH a AS (SELECT DISTINCT o_orderkey AS k, o_custkey % 5 AS m FROM orders), b AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 5 AS m FROM lineitem)
   SELECT k, m, 'orders' AS side FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND b.m = a.m)
   UNION ALL SELECT k, m, 'lines' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.k = a.k AND b.m = a.m)""")
def _only(spark, sf):
    a = J.dealt(table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_custkey % 5 AS m"), ["k", "m"]).distinct()
    b = J.dealt(table(spark, sf, "lineitem").selectExpr("l_orderkey AS k", "l_suppkey % 5 AS m"), ["k", "m"]).distinct()
    return J.only_in_each(a, b, ["k", "m"], ("orders", "lines"))


@query("in_set", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _in(spark, sf):
    m = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return J.in_set(table(spark, sf, "orders"), m, ["o_custkey"]).select("o_orderkey")


@query("lookup_join", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _lookup(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return J.lookup(J.lookup(table(spark, sf, "supplier"), n, ["s_nationkey"]), table(spark, sf, "region"), ["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("union_missing_columns", "SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS nm FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def _union(spark, sf):
    return J.union_all([table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")),
                        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_name").alias("nm"))])


@query("contained_sets", """WITH i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS s FROM lineitem), n AS (SELECT o, count(*) AS c FROM i GROUP BY 1),
   p AS (SELECT x.o AS a, y.o AS b, count(*) AS c FROM i x JOIN i y ON x.s = y.s AND x.o <> y.o GROUP BY 1, 2),
   q AS (SELECT a, b FROM p JOIN n ON n.o = p.a AND n.c = p.c) SELECT a, b FROM q UNION SELECT b, a FROM q""")
def _contained(spark, sf):
    return J.contained_sets(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")


@query("contained_large_sets", """WITH i AS (SELECT DISTINCT l_suppkey % 40 + 40 * (l_orderkey % 3) AS o, l_partkey % 211 AS s FROM lineitem
     WHERE l_partkey % 211 % (l_suppkey % 40 + 1) <= 3 * (l_orderkey % 3) + 5), n AS (SELECT o, count(*) AS c FROM i GROUP BY 1),
   p AS (SELECT x.o AS a, y.o AS b, count(*) AS c FROM i x JOIN i y ON x.s = y.s AND x.o <> y.o GROUP BY 1, 2),
   q AS (SELECT a, b FROM p JOIN n ON n.o = p.a AND n.c = p.c) SELECT a, b FROM q UNION SELECT b, a FROM q""")
def _contained_large(spark, sf):
    i = table(spark, sf, "lineitem").where("l_partkey % 211 % (l_suppkey % 40 + 1) <= 3 * (l_orderkey % 3) + 5")
    return J.contained_sets(i.selectExpr("l_suppkey % 40 + 40 * (l_orderkey % 3) AS o", "l_partkey % 211 AS s"), "o", "s")


@query("rank_groups", f"""SELECT l_suppkey, l_linenumber, {r('q')} AS q, CAST(rank() OVER (PARTITION BY l_suppkey ORDER BY q) AS INT) AS k FROM
   (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) t""")
def _rank(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return windows.rank_groups(g, ["l_suppkey"], F.col("q"), "k")


@query("first_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i FROM orders) q WHERE i = 1""")
def _first(spark, sf):
    return windows.first_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query("first_two", """SELECT o_custkey, max(d) FILTER (WHERE i = 1) AS d1, max(d) FILTER (WHERE i = 2) AS d2 FROM
   (SELECT o_custkey, dayofyear(o_orderdate) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY dayofyear(o_orderdate)) AS i FROM orders) q GROUP BY 1""")
def _first_two(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.dayofyear("o_orderdate").cast("bigint").alias("d"))
    return windows.first_two(o, ["o_custkey"], "d", "d1", "d2")


@query("group_stats", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def _stats(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return windows.group_stats(o, ["o_custkey"], {"n": F.count(F.lit(1)), "top": F.max("o_totalprice")}).select("o_orderkey", "n", "top")


CHUNK = 1000


@query("consecutive_pairs", """SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS A, o_orderkey AS B FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
   QUALIFY lag(o_orderkey) OVER w IS NOT NULL""")
def _pairs(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("node"))
    return windows.consecutive_pairs(o, ["o_custkey"], "o_orderkey", "node", chunk=CHUNK)


@query("mark_changes", """SELECT o_orderkey, CASE WHEN coalesce(lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 'F') <> o_orderstatus
   THEN o_orderstatus END AS changed FROM orders""")
def _changes(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return windows.mark_changes(o, ["o_custkey"], "o_orderkey", "o_orderstatus", "changed", "F", chunk=CHUNK).select("o_orderkey", "changed")


@query("carry_forward", """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER
   (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS since FROM events""")
def _carry(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("mark"))
    return windows.carry_forward(e, ["user_id"], "event_id", "mark", "since", default=-1, chunk=CHUNK).select("event_id", "since")


TIMED = """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 3 END AS k, epoch_us(ts) AS us, concat(event_type, lpad(CAST(event_id AS VARCHAR), 9, '0')) AS name,
   event_type, value FROM events"""


def _timed(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 3 END").alias("k"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("us"),
        F.concat("event_type", F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("name"), "event_type", "value")


@query("previous_by_microsecond", f"""WITH e AS ({TIMED}) SELECT event_id, lag(event_id) OVER w AS previous, {r('lag(value) OVER w')} AS previous_value FROM e
   WINDOW w AS (PARTITION BY k ORDER BY us, event_id)""")
def _by_time(spark, sf):
    e = _timed(spark, sf).withColumn("at", F.struct("us", "event_id"))
    return windows.with_previous(e, ["k"], "at", {"previous": "event_id", "previous_value": "value"}, CHUNK).select("event_id", "previous", "previous_value")


@query("changes_by_microsecond", f"""WITH e AS ({TIMED}) SELECT event_id, CASE WHEN coalesce(lag(event_type) OVER w, 'click') <> event_type THEN event_type END AS changed FROM e
   WINDOW w AS (PARTITION BY k ORDER BY us, event_id)""")
def _changes_by_time(spark, sf):
    e = _timed(spark, sf).withColumn("at", F.struct("us", "event_id"))
    return windows.mark_changes(e, ["k"], "at", "event_type", "changed", "click", CHUNK).select("event_id", "changed")


@query("carry_by_text", f"""WITH e AS ({TIMED}) SELECT event_id, last_value(CASE WHEN value > 90 THEN event_id END IGNORE NULLS) OVER
   (PARTITION BY k ORDER BY name ROWS UNBOUNDED PRECEDING) AS since FROM e""")
def _carry_by_text(spark, sf):
    e = _timed(spark, sf).withColumn("mark", F.when(F.col("value") > 90, F.col("event_id")))
    return windows.carry_forward(e, ["k"], "name", "mark", "since", chunk=CHUNK).select("event_id", "since")


@query("pair_status", with_views("""WITH p AS (SELECT o_orderkey AS k, o_orderkey % 997 AS A, o_custkey % 887 AS B FROM orders),
   l AS (SELECT l_orderkey % 997 AS A, l_partkey % 887 AS B FROM lineitem)
   SELECT k, A, B, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.A = p.A AND l.B = p.B) THEN 'OK' WHEN EXISTS (SELECT 1 FROM l WHERE l.A = p.B AND l.B = p.A)
   THEN 'CHECK_DIR' ELSE 'LINK_MISSING' END AS LINK_HWYNET_STATUS FROM p""", "raw_ixworker"))
def _pair_status(spark, sf):
    p = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "o_orderkey % 997 AS A", "o_custkey % 887 AS B")
    links = table(spark, sf, "lineitem").selectExpr("l_orderkey % 997 AS A", "l_partkey % 887 AS B")
    return J.pair_status(p, links)


@query("text_keys", """SELECT o_orderkey, concat(o_custkey, '_', o_orderstatus) AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'A' WHEN o_orderkey % 3 = 1 THEN 'B' ELSE '2' END AS tag,
   regexp_replace(concat(o_orderpriority, '_A'), '(_A|_B)$', '') AS bare, CAST(o_custkey AS VARCHAR) AS clean FROM orders""")
def _keys(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", S.text_key("o_custkey", "o_orderstatus").alias("key"), S.direction_tag(F.col("o_orderkey") % 3).alias("tag"),
                    S.strip_suffix(F.concat("o_orderpriority", F.lit("_A")), K.DIRECTION_TAGS).alias("bare"),
                    S.clean_number_text(F.col("o_custkey").cast("double").cast("decimal(20,1)")).alias("clean"))


@query("infer_scalar", """SELECT l_orderkey * 8 + l_linenumber AS k, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN 'whole' WHEN l_suppkey % 3 = 1 THEN 'real' ELSE 'text' END AS kind,
   CASE WHEN l_suppkey % 3 = 0 THEN l_partkey END AS whole, CASE WHEN l_suppkey % 3 = 1 THEN l_quantity END AS rl FROM lineitem""")
def _infer(spark, sf):
    li = table(spark, sf, "lineitem")
    text = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_partkey").cast("string")).when(F.col("l_suppkey") % 3 == 1, F.col("l_quantity").cast("string")).otherwise(F.col("l_returnflag"))
    v = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "l_partkey", S.infer_scalar(text).alias("s"))
    return v.select("k", "l_partkey", "s.kind", "s.whole", F.col("s.real").alias("rl"))


@query("clock_times", """SELECT l_orderkey, l_linenumber, l_partkey, m AS minutes, concat(CAST(floor(m / 60) AS BIGINT), ':', lpad(CAST(m % 60 AS VARCHAR), 2, '0')) AS clock,
   CAST(CASE WHEN m < 300 THEN 99 WHEN m < 540 THEN 1 WHEN m < 900 THEN 2 WHEN m < 1080 THEN 3 WHEN m < 1200 THEN 4 WHEN m < 1380 THEN 5 WHEN m < 1600 THEN 6 ELSE 99 END AS INT) AS prd
   FROM (SELECT *, CAST((l_partkey * 37 + l_linenumber) % 1700 AS INT) AS m FROM lineitem) q""")
def _clock(spark, sf):
    m = (F.col("l_partkey") * 37 + F.col("l_linenumber")) % 1700
    text = F.concat_ws(":", F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit("59"))
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.minutes_after_midnight(text).alias("minutes"))
    return t.withColumns({"clock": S.clock_text("minutes"), "prd": S.period_of("minutes")})


@query("clean_timestamp", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS t FROM events""")
def _clean(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit("at <"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("> ok")))
    t = S.clean_timestamp(raw, r"<(\d+-\d+-\d+ \d+:\d+:\d+)>", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf, "events").select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("number_texts", f"SELECT o_orderkey, {r('CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END')} AS v FROM orders")
def _numbers(spark, sf):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", S.coalesce_number(text).alias("v"))


@query("road_classes", f"""SELECT l_orderkey, l_linenumber, l_partkey, {util_sql('l_suppkey % 30', 'l_discount * 13')} AS util, {conglev_sql('l_discount * 13', 'l_tax * 14')} AS lev,
   CASE WHEN a < -135 OR a >= 135 THEN 'W' WHEN a < -45 THEN 'S' WHEN a < 45 THEN 'E' ELSE 'N' END AS dir FROM (SELECT *, l_partkey % 360 - 180 AS a FROM lineitem) q""")
def _classes(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.road_utilization(F.col("l_suppkey") % 30, F.col("l_discount") * 13).alias("util"),
                     S.congestion_level(F.col("l_discount") * 13, F.col("l_tax") * 14).alias("lev"), S.cardinal_direction(F.col("l_partkey") % 360 - 180).alias("dir"))


@query("column_profile", f"""SELECT count(*) AS n_rows, min(l_orderkey) AS min_l_orderkey, max(l_orderkey) AS max_l_orderkey, min(l_linenumber) AS min_l_linenumber,
   max(l_linenumber) AS max_l_linenumber, {r('max(abs(l_quantity - l_quantity::FLOAT::DOUBLE))')} AS err_l_quantity, count(DISTINCT l_returnflag) AS distinct_l_returnflag FROM lineitem""")
def _profile(spark, sf):
    return profiles.column_profile(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))


def _int_type(c):
    return f"""(SELECT CASE WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint' WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
     WHEN min({c}) >= -2147483648 AND max({c}) <= 2147483647 THEN 'int' ELSE 'bigint' END FROM lineitem)"""


def _real_type(c):
    return f"(SELECT CASE WHEN max(abs({c} - {c}::FLOAT::DOUBLE)) = 0 THEN 'float' ELSE 'double' END FROM lineitem)"


NARROWED = {"l_orderkey": _int_type, "l_partkey": _int_type, "l_suppkey": _int_type, "l_linenumber": _int_type, "l_quantity": _real_type, "l_extendedprice": _real_type}


@query("narrow_types", f"""SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {r('l_quantity')} AS l_quantity,
   {r('l_extendedprice')} AS l_extendedprice, {', '.join(f'{f(c)} AS type_{c}' for c, f in NARROWED.items())} FROM lineitem""")
def _narrow(spark, sf):
    """Values as they come back from the narrow types, each with the name of its type."""
    d, _ = profiles.narrow_types(table(spark, sf, "lineitem").select("l_returnflag", *NARROWED))
    return d.select("l_returnflag", *[F.col(c).cast("double" if f is _real_type else "bigint").alias(c) for c, f in NARROWED.items()],
                    *[F.typeof(F.col(c)).alias(f"type_{c}") for c in NARROWED])
