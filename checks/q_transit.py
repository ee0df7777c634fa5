"""Transit lines, GTFS service and their checks."""

from pyspark.sql import functions as F

from checks.domain import view, with_views
from checks.registry import query, r
from parcelflow.operators import spatial
from parcelflow.plans import gtfs_summary as G
from parcelflow.plans import transit as T
from parcelflow.session import scratch_path
from parcelflow.sources import linefile

NODIR = "regexp_replace(line_name, '(_A|_B)$', '')"


def stops_sql(keep_all):
    agg = lambda p, n: f"coalesce(string_agg(line, ';' ORDER BY line) FILTER (WHERE {p}), '') AS {n}"
    return f"""WITH sv AS (SELECT {NODIR} AS line, min(mode) AS mode, min(color) AS color, min(headway1) AS h1, min(headway3) AS h3 FROM t_lines GROUP BY 1),
      st AS (SELECT DISTINCT {NODIR} AS line, node FROM t_nodes WHERE stop = 'Y'),
      sd AS (SELECT st.line, st.node, mode = 1 AS rail, color = 4 AS brt, mode <> 1 AND color <> 4 AND h1 > 0 AND h1 <= 15 AND h3 > 0 AND h3 <= 15 AS hf FROM st JOIN sv ON sv.line = st.line),
      pn AS (SELECT node, {agg('true', 'all_lines')}, {agg('rail', 'rail_lines')}, {agg('brt', 'brt_lines')}, {agg('hf', 'hifreq_lines')},
               count(*) FILTER (WHERE hf) AS cnt_hifreqlines FROM sd GROUP BY node),
      hs AS (SELECT line, node FROM sd WHERE hf), sz AS (SELECT line, count(*) AS c FROM hs GROUP BY 1),
      cm AS (SELECT x.line AS a, y.line AS b, count(*) AS c FROM hs x JOIN hs y ON x.node = y.node AND x.line <> y.line GROUP BY 1, 2),
      ov AS (SELECT a, b FROM cm JOIN sz p ON p.line = a JOIN sz q ON q.line = b WHERE cm.c = p.c OR cm.c = q.c),
      wn AS (SELECT x.node, string_agg(concat(a, '-', b, ';'), '' ORDER BY concat(a, '-', b, ';')) AS w FROM ov JOIN hs x ON x.line = ov.a JOIN hs y ON y.line = ov.b AND y.node = x.node
             JOIN pn ON pn.node = x.node WHERE pn.rail_lines = '' AND pn.brt_lines = '' AND cnt_hifreqlines > 1 GROUP BY 1)
      SELECT pn.*, coalesce(w, '') AS overlap_warning FROM pn LEFT JOIN wn ON wn.node = pn.node
      {'' if keep_all else "WHERE rail_lines <> '' OR brt_lines <> '' OR cnt_hifreqlines > 1"}"""


for _keep in (False, True):
    @query("major_transit_stops_all" if _keep else "major_transit_stops", with_views(stops_sql(_keep), "t_lines", "t_nodes"))
    def _stops(spark, sf, keep=_keep):
        return T.major_transit_stops(view(spark, sf, "t_lines"), view(spark, sf, "t_nodes"), keep_all=keep)


@query("check_transit_links", with_views("""WITH p AS (SELECT n.line_name, seq, CAST(lag(node) OVER w AS BIGINT) AS A, CAST(node AS BIGINT) AS B FROM t_nodes n
     JOIN t_lines l ON l.line_name = n.line_name WHERE l.mode <> 1 WINDOW w AS (PARTITION BY n.line_name ORDER BY seq)),
   k AS (SELECT DISTINCT A, B FROM t_links)
   SELECT line_name AS NAME, seq, p.A, p.B, CASE WHEN v.A IS NOT NULL THEN 'CHECK_DIR' ELSE 'LINK_MISSING' END AS LINK_HWYNET_STATUS FROM p
   LEFT JOIN k f ON f.A = p.A AND f.B = p.B LEFT JOIN k v ON v.A = p.B AND v.B = p.A WHERE p.A IS NOT NULL AND f.A IS NULL""", "t_nodes", "t_lines", "t_links"))
def _check(spark, sf):
    return T.check_transit_links(*[view(spark, sf, v) for v in ("t_lines", "t_nodes", "t_links")])


@query("line_features", with_views("""SELECT l.line_name, mode, count(*) AS n_points, concat('LINESTRING (', string_agg(concat(x.X::DOUBLE::VARCHAR, ' ', x.Y::DOUBLE::VARCHAR), ', ' ORDER BY seq), ')') AS wkt
   FROM t_nodes n JOIN t_node_xy x ON x.N = CAST(n.node AS BIGINT) JOIN t_lines l ON l.line_name = n.line_name GROUP BY 1, 2""", "t_nodes", "t_node_xy", "t_lines"))
def _features(spark, sf):
    out = T.line_features(view(spark, sf, "t_lines"), view(spark, sf, "t_nodes"), view(spark, sf, "t_node_xy"))
    return out.select("line_name", "mode", "n_points", "wkt")


@query("points_from_links", with_views("SELECT k.A, k.B, CAST(x.X AS DOUBLE) AS x, CAST(x.Y AS DOUBLE) AS y FROM t_links k JOIN t_node_xy x ON x.N = k.A", "t_links", "t_node_xy"))
def _points(spark, sf):
    return spatial.attach_coordinates(view(spark, sf, "t_links"), view(spark, sf, "t_node_xy"), "A").select("A", "B", "x", "y")


SEQ = "CAST(row_number() OVER (PARTITION BY n.line_name ORDER BY seq) - 1 AS INT)"


@query("line_file_round_trip", with_views(f"""SELECT n.line_name, node, {SEQ} AS seq, stop, CASE WHEN row_number() OVER (PARTITION BY n.line_name ORDER BY seq) = 1 THEN '0' ELSE tf END AS tf
   FROM t_nodes n JOIN t_lines l ON l.line_name = n.line_name""", "t_nodes", "t_lines"))
def _round_trip(spark, sf):
    path = scratch_path(spark, "linefile")
    linefile.write_line_file(view(spark, sf, "t_lines"), view(spark, sf, "t_nodes"), path)
    return linefile.read_line_file(spark, path)[1]


@query("line_file_lines", with_views(f"""SELECT line_name, longname, oneway, mode, faresystem, operator, color, circular,
   {', '.join(f'timefac{i}, headway{i}' for i in range(1, 6))} FROM t_lines""", "t_lines"))
def _lines(spark, sf):
    path = scratch_path(spark, "linefile")
    linefile.write_line_file(view(spark, sf, "t_lines"), view(spark, sf, "t_nodes"), path)
    return linefile.read_line_file(spark, path)[0]


@query("line_tables_round_trip", with_views("SELECT line_name, node, CAST(seq AS INT) AS seq, stop, tf FROM t_nodes", "t_nodes"))
def _tables(spark, sf):
    path = scratch_path(spark, "linetables")
    linefile.write_line_tables(view(spark, sf, "t_lines"), view(spark, sf, "t_nodes"), path)
    return linefile.read_line_tables(spark, path)[1]


# ------------------------------------------------------------------ GTFS

MILES = """CASE WHEN plat IS NULL THEN 0 ELSE 2 * 3958.7613 * asin(least(1, sqrt(power(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2)))) END"""
SHAPES = f"""sh AS (SELECT agency, shape_id, coalesce(sum({MILES}), 0) AS mi FROM (SELECT agency, shape_id, shape_pt_lon AS lon, shape_pt_lat AS lat,
     lag(shape_pt_lon) OVER w AS plon, lag(shape_pt_lat) OVER w AS plat FROM g_shapes WINDOW w AS (PARTITION BY agency, shape_id ORDER BY shape_pt_sequence)) q GROUP BY 1, 2)"""


@query("polyline_miles", with_views(f"WITH {SHAPES} SELECT agency, shape_id, {r('mi')} AS length_mi FROM sh", "g_shapes"))
def _miles(spark, sf):
    return spatial.polyline_miles(view(spark, sf, "g_shapes"), ["agency", "shape_id"], "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat")


def prd(m):
    from parcelflow.constants import GTFS_PERIODS
    return "CASE " + " ".join(f"WHEN {m} >= {a} AND {m} < {b} THEN {k}" for k, (a, b) in GTFS_PERIODS.items()) + " ELSE 99 END"


EVENTS = f"""ev AS (SELECT x.*, {prd('dep')} AS p FROM (
      SELECT r.agency, r.agency_id, r.route_long_name, t.trip_id, t.shape_id, concat(r.agency, r.route_id, '_', CASE t.direction_id WHEN 0 THEN 'A' ELSE 'B' END) AS rt,
        s.stop_id, s.stop_sequence, CASE WHEN s.departure_time IS NULL THEN 0 ELSE CAST(split_part(s.departure_time, ':', 1) AS INT) * 60 + CAST(split_part(s.departure_time, ':', 2) AS INT) END AS dep
      FROM g_routes r JOIN g_trips t ON t.route_id = r.route_id AND t.agency = r.agency LEFT JOIN g_stop_times s ON s.trip_id = t.trip_id AND s.agency = t.agency
      JOIN g_calendar c ON c.service_id = t.service_id AND c.agency = t.agency WHERE c.monday = 1 AND c.saturday = 0 AND c.sunday = 0) x),
   tp AS (SELECT agency, rt, agency_id, route_long_name, trip_id, max(shape_id) AS shape_id, count(stop_id) AS stops, min(p) AS p0, max(dep) AS dend,
        min(dep) FILTER (WHERE stop_sequence = 1) AS d1 FROM ev GROUP BY 1, 2, 3, 4, 5),
   tm AS (SELECT *, max(stops) OVER (PARTITION BY rt) AS most FROM tp),
   tk AS (SELECT tm.*, {prd('d1')} AS dp, dend - d1 AS dur, mi, row_number() OVER (PARTITION BY rt, {prd('d1')} ORDER BY d1) AS i
          FROM tm LEFT JOIN sh ON sh.shape_id = tm.shape_id AND sh.agency = tm.agency WHERE CASE WHEN d1 < 300 THEN 99 ELSE p0 END < 6)"""


def gtfs_sql():
    from parcelflow.constants import GTFS_PERIODS
    cols = []
    for k, (a, b) in GTFS_PERIODS.items():
        if k == 6:
            continue
        f = f"FILTER (WHERE dp = {k} AND d1 IS NOT NULL)"
        first, second = f"max(d1) FILTER (WHERE dp = {k} AND i = 1)", f"max(d1) FILTER (WHERE dp = {k} AND i = 2)"
        cols += [f"nullif(count(*) {f}, 0) AS tripcnt_{k}", f"{first} AS first_dep{k}", f"{second} AS second_dep{k}", f"{r(f'{b - a} / nullif(count(*) {f}, 0)')} AS avgheadway_{k}",
                 f"{second} - {first} AS iheadway_{k}", f"{r(f'sum(dur) {f} / 60')} AS vsh_{k}",
                 f"{r(f'coalesce(avg(dur) FILTER (WHERE dp = {k} AND stops = most), avg(dur) {f})')} AS avg_trpdur{k}",
                 f"{r(f'(CASE WHEN count(*) {f} > 0 THEN coalesce(sum(mi) {f}, 0) END) / nullif(sum(dur) {f} / 60, 0)')} AS avg_speed{k}",
                 f"{r(f'CASE WHEN count(*) {f} > 0 THEN coalesce(sum(mi) {f}, 0) END')} AS vsm{k}"]
    return f"WITH {SHAPES}, {EVENTS} SELECT rt AS uniq_rte_name, agency_id, route_long_name, {', '.join(cols)} FROM tk GROUP BY 1, 2, 3"


FEED = ("g_routes", "g_trips", "g_stop_times", "g_calendar", "g_shapes")


@query("gtfs_line_summary", with_views(gtfs_sql(), *FEED))
def _gtfs(spark, sf):
    return G.gtfs_line_summary(*[view(spark, sf, v) for v in FEED])


@query("gtfs_weekday_trips", with_views(f"WITH {SHAPES}, {EVENTS} SELECT rt AS uniq_rte_name, trip_id, stops AS n_stops, most AS max_stops, d1 AS dep1, dend AS last_dep FROM tm", *FEED))
def _weekday(spark, sf):
    t = G.weekday_trips(*[view(spark, sf, v) for v in FEED[:4]])
    return t.select("uniq_rte_name", "trip_id", "n_stops", "max_stops", "dep1", F.coalesce("last_dep", F.lit(0)).alias("last_dep"))


@query("gtfs_service_span", with_views(f"""WITH {SHAPES}, {EVENTS}, z AS (SELECT max(dend) AS a, min(d1) AS b, max(d1) AS c FROM tk)
   SELECT {', '.join(f"concat(CAST(floor({x} / 60) AS BIGINT), ':', lpad(CAST({x} % 60 AS VARCHAR), 2, '0')) AS {n}" for x, n in (('a', 'latest_departure'), ('b', 'earliest_start'), ('c', 'latest_start')))} FROM z""", *FEED))
def _span(spark, sf):
    return G.service_span(G.model_hour_trips(G.weekday_trips(*[view(spark, sf, v) for v in FEED[:4]])))
