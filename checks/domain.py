"""Model-run, speed, network, transit and geometry tables derived row by row from the given tables.

Every view is a list of expressions over one whole table, in SQL that Spark and DuckDB read alike, so the
registered queries and their checks start from the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelflow.operators.joins import dealt


def _d(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


def _b(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def _fl(e: str) -> str:
    return f"CAST(floor({e}) AS BIGINT)"


HOME = _fl("o_custkey / 3") + " * 2"
EMPS = {"empedu": 3, "empfoo": 4, "empgov": 5, "empind": 6, "empmed": 7, "empofc": 8, "empret": 9, "empsvc": 10, "empoth": 11}

VIEWS: dict[str, tuple[str, dict[str, str]]] = {}

VIEWS["raw_hh"] = ("customer", {
    "hhno": "c_custkey", "hhsize": _b("CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE c_custkey % 5 + 1 END"),
    "hhvehs": _b("CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE c_custkey % 4 END"),
    "hhincome": _fl("c_acctbal * 10"), "hrestype": _b("CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END"),
    "hhparcel": _fl("c_custkey / 3") + " * 2"})
VIEWS["raw_person"] = ("orders", {
    "id": "o_orderkey", "hhno": "o_custkey", "pno": "o_orderkey", "pptyp": "o_orderkey % 9", "pwtyp": "o_orderkey % 3",
    "pwpcl": f"CASE WHEN o_orderkey % 11 = 0 THEN {HOME} ELSE {_fl('o_orderkey / 8')} END"})
VIEWS["population"] = ("orders", {
    "serialno": "CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_custkey END", "pnum": "o_orderkey", "hhcel": HOME,
    "relate": "CASE WHEN o_orderkey % 20 = 0 THEN 17 WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 6 END",
    "age": "o_orderkey % 90", "ethc": "o_orderkey % 6"})
VIEWS["raw_personday"] = ("orders", {
    "person_id": "o_orderkey", "hhno": "o_custkey", "pno": "o_orderkey", "wktours": "o_orderkey % 5 % 2",
    "wkathome": "CASE WHEN o_orderkey % 4 < 2 THEN 0 WHEN o_orderkey % 4 = 2 THEN 4 ELSE NULL END"})
VIEWS["raw_tour"] = ("orders", {
    "id": "o_orderkey", "person_id": "o_orderkey - o_orderkey % 3", "hhno": "o_custkey",
    "parent": "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END", "pdpurp": "o_orderkey % 4", "tmodetp": "o_orderkey % 9 + 1",
    "topcl": _fl("o_orderkey / 9"), "tdpcl": _fl("o_orderkey / 8")})
VIEWS["raw_trip"] = ("lineitem", {
    "id": "l_orderkey * 8 + l_linenumber", "tour_id": "l_orderkey", "mode": "(l_linenumber + l_orderkey) % 9 + 1",
    "pathtype": "l_partkey % 6",
    "dorp": "CASE l_suppkey % 8 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 11 WHEN 3 THEN 12 WHEN 4 THEN 13 WHEN 5 THEN 21 WHEN 6 THEN 22 ELSE 23 END",
    "travtime": "l_quantity", "travdist": "l_extendedprice / 9973", "timeau": "l_quantity * l_tax * 20",
    "distau": "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_extendedprice / 4999 END",
    "distcong": "l_extendedprice * l_discount / 4993", "hhno": _fl("l_orderkey / 10"), "pno": "l_orderkey"})
# person keys that agree with the trips' own household and person numbers
VIEWS["tw_person"] = ("orders", VIEWS["raw_person"][1] | {"hhno": _fl("o_orderkey / 10")})
VIEWS["tw_personday"] = ("orders", VIEWS["raw_personday"][1] | {"hhno": _fl("o_orderkey / 10")})
VIEWS["raw_parcel"] = ("part", {
    "parcelid": "p_partkey", "taz_p": _fl("p_partkey / 20") + " + 25", "hh_p": _d("p_size % 7"),
    "stugrd_p": f"CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE {_d('p_size % 4')} END",
    "stuhgh_p": f"CASE WHEN p_partkey % 20 = 0 THEN NULL ELSE {_d('p_size % 3')} END", "stuuni_p": _d("p_size % 2"),
    **{f"{e}_p": _d(f"(p_size + p_partkey) % {k}") for e, k in EMPS.items()},
    "emptot_p": "CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE " + " + ".join(_d(f"(p_size + p_partkey) % {k}") for k in EMPS.values()) + " END",
    "parkdy_p": _d("p_size % 5"), "hh_2": _d("(p_size % 10) * 1500"), "emptot_2": _d("(p_size % 5) * 2500"),
    "stugrd_2": _d("(p_size % 4) * 500"), "stuhgh_2": _d("(p_size % 3) * 700"), "empret_2": _d("(p_size % 6) * 300"),
    "empsvc_2": f"CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE {_d('(p_size % 7) * 90')} END",
    "dist_lbus": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice / 1000 END",
    "dist_lrt": f"CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE {_d('p_size')} / 30 END",
    "nodes1_2": _d("p_size"), "nodes3_2": f"CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE {_d('p_size * 2')} END", "nodes4_2": _d("p_size * 3")})
VIEWS["raw_cveh"] = ("supplier", {"I": "s_suppkey + 25", **{
    f"C{a}_{m}_I": f"abs(s_acctbal) / {a * k}" for a in (2, 3) for k, m in enumerate(("VT", "VMT", "CVMT", "VHT"), 2)}})
VIEWS["raw_ixxi"] = ("supplier", {"I": "s_suppkey + 25", **{
    f"IX_{m}_{e}": f"abs(s_acctbal) / {k + j}" for k, m in enumerate(("VT", "VHT", "VMT", "CVMT"), 2) for j, e in enumerate("IJ")},
    "HHS": _d("s_suppkey % 300"), "EMPTOT": _d("s_suppkey % 500 + 100"), "FOOD": _d("s_suppkey % 11"),
    "RET": _d("s_suppkey % 13"), "SVC": _d("s_suppkey % 17")})
VIEWS["raw_ixworker"] = ("supplier", {"TAZ": "s_suppkey + 25", "IXWkrFraxn": _d("s_suppkey % 7") + " / 50", "extWkrfraxn": _d("s_suppkey % 10") + " / 100"})
VIEWS["taz_rad"] = ("supplier", {"taz": "s_suppkey + 25", "RAD": "CASE WHEN s_suppkey % 23 = 22 THEN NULL ELSE s_nationkey END"})
VIEWS["master"] = ("part", {"PARCELID": "p_partkey", "GISAc": _d("p_size") + " / 10", "XCOORD": "p_partkey * 3", "YCOORD": "p_partkey * 5",
                            "RAD_07": "p_size % 9", "TAZ_07": _fl("p_partkey / 20"), "TPA_20": "p_brand"})
VIEWS["land_use"] = ("part", {"PARCELID": "CASE WHEN p_partkey % 17 = 0 THEN -1 - p_partkey ELSE p_partkey END", "COUNTY": "p_type",
                              "JURIS": "p_brand", "TAZ_21": _fl("p_partkey / 20"), "DU": "p_size", "LU": "p_name"})

VIEWS["epochs"] = ("events", {"tmc_code": "concat('T', user_id)", "measurement_tstamp": "ts", "speed": "value",
                              "travel_time_seconds": "value * 3 + 1"})
VIEWS["segments"] = ("customer", {"tmc": "concat('T', c_custkey)", "road": "c_mktsegment", "route_numb": "c_nationkey",
                                  "f_system": "c_nationkey % 5 + 1", "nhs": "c_nationkey % 2", "miles": "c_acctbal / 997 + 2",
                                  "cmp_tag": "c_custkey % 2", "direction": "CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE 'S' END"})
VIEWS["segments_new"] = ("customer", {"tmc": "concat('T', c_custkey + 10)", "miles": "c_acctbal / 907 + 2"})

PERIOD_HOURS = ["H07", "H08", "H16", "H17"]


def _net(shift: int, capclass: str) -> dict[str, str]:
    n = lambda k, m, scale="1": _d(f"(o_orderkey * {k} + {shift * k}) % {m}") + f" / {scale}"
    cols = {"A": f"CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + {shift} ELSE o_custkey END", "B": "o_orderkey", "NAME": "o_orderpriority",
            "DISTANCE": n(3, 700, "100"), "SCREEN": "o_orderkey % 12", "RAD": "o_orderkey % 70", "HWYSEG": "o_orderkey % 40",
            "TRAV_DIR": "o_orderkey % 4", "FWYID": "o_orderkey % 21", "COUNTID": "o_orderkey % 6",
            "SACTRAK": f"CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE concat('P', {_fl('o_custkey / 10')}) END",
            "PHASE2": "CASE WHEN o_orderkey % 5 = 0 THEN 'B' ELSE ' ' END",
            "LANES": f"CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE {_d(f'(o_orderkey + {shift}) % 5')} END", "CAPCLASS": capclass,
            "SPEED": n(7, 70), "BIKE": "o_orderkey % 3", "LANEMI": n(11, 900, "100"), "DYV": n(13, 9000),
            "DAYVMT": n(17, 5000), "DAYCVMT": n(19, 900)}
    for i, p in enumerate(["A3", "MD", "P3", "EV"]):
        cols |= {f"{p}V": n(23 + i, 4000), f"{p}S": n(29 + i, 65), f"{p}VMT": n(37 + i, 3000), f"{p}CVMT": n(41 + i, 400),
                 f"{p}VC": n(43 + i, 140, "100")}
    for i, p in enumerate(PERIOD_HOURS):
        cols |= {f"{p}V": f"CASE WHEN o_orderkey % 17 = 0 THEN 0 * {_d('o_orderkey')} ELSE {n(47 + i, 1500)} END",
                 f"{p}VMT": n(53 + i, 2000), f"{p}CVMT": n(59 + i, 300), f"{p}VC": n(61 + i, 130, "100"), f"{p}SPDGRP": n(67 + i, 70)}
    return cols


VIEWS["net_base"] = ("orders", _net(0, "CASE WHEN o_orderkey % 14 = 0 THEN 99 ELSE o_orderkey % 30 END"))
VIEWS["net_future"] = ("orders", _net(1, "CASE WHEN o_orderkey % 15 = 0 THEN 99 ELSE (o_orderkey + o_custkey % 2) % 30 END"))
VIEWS["yearly"] = ("orders", {
    "A": "o_custkey", "B": "o_orderkey", "SACTRAK": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('P', o_custkey) END", "PHASE2": "o_orderstatus",
    **{f"{a}{y}": (f"CASE WHEN o_orderkey % {k + i} = 1 THEN NULL ELSE (o_orderkey + CASE WHEN o_orderkey % {k + 2} < {i} THEN 1 ELSE 0 END) % {k} END")
       for k, a in ((5, "SPD"), (7, "CAPC"), (4, "LANE"), (3, "BIKE")) for i, y in enumerate(("16", "20", "35", "35_DPS", "40_DPS"))}})

VIEWS["t_lines"] = ("customer", {
    "line_name": f"concat('L', {_fl('c_custkey / 2')}, CASE WHEN c_custkey % 2 = 0 THEN '_A' ELSE '_B' END)", "longname": "c_name",
    "oneway": "'T'", "mode": "CAST(CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 3 END AS INT)", "faresystem": "CAST(c_nationkey AS VARCHAR(9))",
    "operator": "CAST(c_nationkey % 7 AS VARCHAR(9))", "color": "CAST(CASE WHEN c_custkey % 13 = 0 THEN 4 ELSE 2 END AS INT)", "circular": "'F'",
    **{f"timefac{i}": _d("c_custkey % 4") + " / 2" for i in range(1, 6)}, **{f"headway{i}": _d(f"c_custkey % {21 - i}") for i in range(1, 6)}})
VIEWS["t_nodes"] = ("orders", {
    "line_name": f"concat('L', {_fl('o_custkey / 2')}, CASE WHEN o_custkey % 2 = 0 THEN '_A' ELSE '_B' END)",
    "node": f"CAST({_fl('o_custkey / 8')} * 5 + o_orderkey % 5 AS VARCHAR(20))", "seq": "o_orderkey",
    "stop": "CASE WHEN o_orderkey % 4 = 0 THEN 'N' ELSE 'Y' END",
    "tf": "CASE WHEN o_orderkey % 9 < 3 THEN '0' WHEN o_orderkey % 9 < 7 THEN '1.5' ELSE '2.25' END"})
VIEWS["t_links"] = ("orders", {"A": f"{_fl('o_custkey / 8')} * 5 + o_orderkey % 5", "B": f"{_fl('o_custkey / 8')} * 5 + (o_orderkey + o_custkey) % 5"})
VIEWS["t_coords"] = ("orders", {"N": f"{_fl('o_custkey / 8')} * 5 + o_orderkey % 5", "X": f"{_fl('o_custkey / 8')} * 5 + o_orderkey % 5 + 0", "Y": "o_orderkey % 5"})

AGENCY = "concat('AG', {r} % 5)"
_R = _fl("o_custkey / 10")
VIEWS["g_trips"] = ("orders", {"agency": AGENCY.format(r=_R), "route_id": f"concat('R', {_R})", "trip_id": "o_orderkey", "direction_id": "o_orderkey % 2",
                               "service_id": "concat('S', o_orderkey % 4)", "shape_id": f"concat('SH', {_R})"})
VIEWS["g_routes_raw"] = ("customer", {"agency": AGENCY.format(r=_fl("c_custkey / 10")), "agency_id": "concat('id', " + _fl("c_custkey / 10") + " % 5)",
                                      "route_id": "concat('R', " + _fl("c_custkey / 10") + ")", "route_long_name": "concat('Route ', " + _fl("c_custkey / 10") + ")"})
VIEWS["g_stops_raw"] = ("lineitem", {"trip_id": "l_orderkey", "stop_sequence": "l_linenumber", "stop_id": "l_partkey"})
VIEWS["g_calendar_raw"] = ("region", {"service_id": "concat('S', r_regionkey)", "monday": "CASE WHEN r_regionkey = 3 THEN 0 ELSE 1 END",
                                      "saturday": "CASE WHEN r_regionkey = 3 THEN 1 ELSE 0 END", "sunday": "0"})
VIEWS["g_shapes"] = ("events", {"agency": AGENCY.format(r="user_id"), "shape_id": "concat('SH', user_id)", "shape_pt_sequence": "event_id",
                                "shape_pt_lon": "value / 1000 - 121", "shape_pt_lat": _d("event_id % 100") + " / 1000 + 38"})

VIEWS["links_geo"] = ("orders", {
    "link_id": "o_orderkey", "capc": "o_orderkey % 8", "x1": _d("(o_orderkey * 7919) % 20011"), "y1": _d("(o_orderkey * 104729) % 20021"),
    "x2": _d("(o_orderkey * 7919) % 20011 + o_orderkey % 201 - 100"), "y2": _d("(o_orderkey * 104729) % 20021 + o_custkey % 201 - 99")})
VIEWS["segs_geo"] = ("customer", {
    "seg_id": "c_custkey", "fwytag": "c_custkey % 3", "miles": "c_acctbal / 997 + 2", "roadname": "c_mktsegment",
    "x1": _d("(c_custkey * 6151) % 20011"), "y1": _d("(c_custkey * 12289) % 20021"),
    "x2": _d("(c_custkey * 6151) % 20011 + (c_custkey % 31 - 15) * 20"), "y2": _d("(c_custkey * 12289) % 20021 + (c_custkey % 37 - 18) * 20 + 1"),
    "x3": _d("(c_custkey * 6151) % 20011 + (c_custkey % 31 - 15) * 45"), "y3": _d("(c_custkey * 12289) % 20021 + (c_custkey % 37 - 18) * 38 + 2")})
VIEWS["parcel_boxes"] = ("part", {
    "parcelid": "p_partkey", "x0": _d("(p_partkey * 7919) % 5003"), "y0": _d("(p_partkey * 104729) % 5009"),
    "x1": _d("(p_partkey * 7919) % 5003 + p_size + 3"), "y1": _d("(p_partkey * 104729) % 5009 + p_size % 17 + 4"),
    "POP": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END", "EMP": "p_retailprice"})
VIEWS["zone_boxes"] = ("supplier", {
    "zone_id": "s_suppkey", "x0": _d("(s_suppkey * 613) % 5003"), "y0": _d("(s_suppkey * 1237) % 5009"),
    "x1": _d("(s_suppkey * 613) % 5003 + 250 + s_suppkey % 90"), "y1": _d("(s_suppkey * 1237) % 5009 + 300")})

# views that need an aggregate or a distinct over a view above
DERIVED = {
    "g_routes": "SELECT DISTINCT agency, agency_id, route_id, route_long_name FROM g_routes_raw",
    "g_calendar": "SELECT DISTINCT t.agency, c.service_id, c.monday, c.saturday, c.sunday FROM g_trips t JOIN g_calendar_raw c ON c.service_id = t.service_id",
    "g_stop_times": """
        SELECT agency, trip_id, stop_sequence, stop_id, CASE WHEN stop_id % 29 = 0 THEN NULL ELSE
               concat(lpad(CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR(9)), 2, '0'), ':', lpad(CAST(m % 60 AS VARCHAR(9)), 2, '0'), ':00') END AS departure_time
        FROM (SELECT t.agency, s.trip_id, s.stop_sequence, min(s.stop_id) AS stop_id,
                     (s.trip_id % 19 + 4) * 60 + s.stop_sequence * 13 + s.trip_id % 3 AS m
              FROM g_stops_raw s JOIN g_trips t ON s.trip_id = t.trip_id
              GROUP BY t.agency, s.trip_id, s.stop_sequence) q""",
    "t_node_xy": "SELECT DISTINCT N, X, Y FROM (SELECT N, max(X) AS X, max(Y) AS Y FROM t_coords GROUP BY N) q",
}
DERIVED_NEEDS = {"g_routes": ["g_routes_raw"], "g_calendar": ["g_calendar_raw", "g_trips"], "g_stop_times": ["g_stops_raw", "g_trips"],
                 "t_node_xy": ["t_coords"]}
#: The key that a view's tables are joined on, where both are large: they are dealt out to all tasks by it.
DERIVED_BY = {"g_stop_times": "trip_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a lazy DataFrame."""
    if name in VIEWS:
        source, cols = VIEWS[name]
        return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])
    needs = {n: view(spark, sf_dir, n) for n in DERIVED_NEEDS[name]}
    if name in DERIVED_BY:
        needs = {n: dealt(v, [DERIVED_BY[name]]) for n, v in needs.items()}
    text = DERIVED[name]
    for n in needs:
        text = text.replace(f"FROM {n}", "FROM {" + n + "}").replace(f"JOIN {n} ", "JOIN {" + n + "} ")
    return spark.sql(text, **needs)


def with_views(body: str, *names: str) -> str:
    """The check SQL with the same derived tables as CTEs."""
    parts, seen = [], set()

    def add(n):
        if n in seen:
            return
        seen.add(n)
        if n in VIEWS:
            source, cols = VIEWS[n]
            parts.append(f"{n} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {source})")
        else:
            for m in DERIVED_NEEDS[n]:
                add(m)
            parts.append(f"{n} AS ({DERIVED[n]})")

    for n in names:
        add(n)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(parts) + ", " + body[4:]
    return "WITH " + ",\n".join(parts) + "\n" + body
