import math

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.plans import combined, conflation, gtfs_summary, network, speeds, themes, transit, zones


def rows(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def run(spark):
    """A small run: parcel 1 has two households, 2 a dorm, 3 only work ends, 4 nothing."""
    c = spark.createDataFrame
    return {
        "parcel": c([(1, 40, 4.0), (2, 40, 6.0), (3, 41, 10.0), (4, 99, None)], "parcelid int, taz_p int, emptot_p double"),
        "hh": c([(10, 2, 1, 14999, 1, 1), (11, 1, 0, 75000, 0, 1), (12, 1, None, 20000, 1, 2)],
                "hhno int, hhsize int, hhvehs int, hhincome int, hrestype int, hhparcel int"),
        "pop": c([(10, 1, 1, 0, 34, 1), (10, 2, 1, 1, 30, 2), (11, 1, 1, 0, 65, 3), (12, 1, 2, 17, 20, 9)],
                 "serialno int, pnum int, hhcel int, relate int, age int, ethc int"),
        "person": c([(100, 10, 1, 1, 1, 3), (101, 10, 2, 4, 0, None), (102, 11, 1, 2, 1, 1), (103, 12, 1, 5, 2, 3)],
                    "id int, hhno int, pno int, pptyp int, pwtyp int, pwpcl int"),
        "tour": c([(1, 100, 10, 1, 0, 3, 1, 3), (2, 100, 10, 4, 1, 3, 2, 1), (3, 101, 10, 2, 0, 4, 3, 2), (4, 999, 10, 1, 0, 3, 1, 3)],
                  "id int, person_id int, hhno int, pdpurp int, parent int, tdpcl int, topcl int, tmodetp int"),
        "trip": c([(1, 1, 10, 1, 3, 0, 1, 30.0, 10.0, 30.0, 10.0, 1.0), (2, 1, 10, 1, 4, 0, 2, 30.0, 10.0, 30.0, 10.0, 2.0),
                   (3, 2, 10, 1, 9, 0, 21, 60.0, 6.0, 0.0, 6.0, 0.0), (4, 3, 10, 2, 6, 4, None, 60.0, 5.0, None, None, None), (5, 4, 10, 1, 3, 0, 1, 30.0, 10.0, 30.0, 10.0, 1.0)],
                  "id int, tour_id int, hhno int, pno int, mode int, pathtype int, dorp int, travtime double, travdist double, timeau double, distau double, distcong double"),
        "ext": c([(40, 0.1)], "TAZ int, extWkrfraxn double"),
        "day": c([(100, 10, 1, 1, 0), (102, 11, 1, 0, 4), (102, 11, 1, 0, 4), (103, 12, 1, 0, 0)], "person_id int, hhno int, pno int, wktours int, wkathome int")}


def test_household(run):
    for av in (False, True):
        r = rows(themes.theme_household(run["pop"], run["hh"], run["parcel"], av), "parcelid")
        assert (r[1].HH_TOT_P, r[1].HH_hh, r[1].HH_INC_1, r[1].HH_INC_5, r[1].HH_HD_1, r[1].HH_HD_3, r[1].VEHICLE, r[1].HH_NOVEH) == (2, 2, 1, 1, 1, 1, 1, 1)
        assert (r[2].HH_TOT_P, r[2].HH_hh, r[2].VEHICLE) == (1, 0, 0)  # dorm, no head
        assert r[4].HH_TOT_P == 0 and r[4].VEH_AV == 0 and r[1].VEH_AV == (1 if av else 0)


def test_person(run):
    r = rows(themes.theme_person(run["pop"], run["person"], run["parcel"]), "parcelid")
    assert (r[1].POP_TOT, r[1].POP_HH, r[1].WKRS_tot, r[1].WAH, r[1].WKRS_JOBLOCN) == (3, 3, 2, 1, 1)
    assert (r[2].POP_TOT, r[2].POP_HH) == (1, 0) and (r[3].POP_TOT, r[3].WKRS_JOBLOCN) == (0, 2) and r[4].POP_TOT == 0


def test_triptour(run):
    t = lambda rule: rows(themes.theme_triptour(*[run[k] for k in ("trip", "tour", "person", "hh", "parcel", "ext")], rule=rule), "parcelid")
    r = t("constants")
    one = r[1]
    assert (one.PT_TOT_RES, one.VT_TOT_RES, one.PT_WRK_RES, one.SOV_TOT_RES, one.HOV_TOT_RES, one.TNC_WRK_RES, one.TRN_LRT_RES) == (4, 1, 3, 1, 1, 1, 1)
    assert math.isclose(one.II_VMT_RES, 10 + 5 + 6 * 1.4) and math.isclose(one.VMT_WRK_RES, 23.4) and math.isclose(one.II_CVMT_RES, 2.0)
    assert math.isclose(one.PHR_TOT_RES, 3 / 60) and math.isclose(one.PHR_WRK_RES, 2.0) and math.isclose(one.VHR_TOT_RES, 0.75)
    assert math.isclose(one.GMI_TOT_RES, 10 * 595.8 + 5 * 595.8 + 8.4 * 937.0)
    assert one.PTO_TOT_RES == 4 and one.PTOURSOV == 2 and math.isclose(one.JOB_ExWorker, 0.4)
    # parcel 3 is only a destination: adding the missing origin side gives 0
    assert (r[3].VMT_wrk_tourend, r[3].PT_wrk_tourend, r[3].PT_TOT_RES, r[3].II_VMT_RES, r[3].VMT_WRK_RES) == (0, 0, 0, None, 0)
    assert r[4].PT_TOT_RES == 0 and r[4].PTO_TOT_RES is None and r[4].JOB_ExWorker is None
    d = t("dorp")
    assert math.isclose(d[1].II_VMT_RES, 10) and d[3].PT_wrk_tourend == 3 and d[4].PT_wrk_tourend is None
    tours = themes.tour_rows(*[run[k] for k in ("trip", "tour", "person", "hh")])
    loose = rows(themes.work_tour_end(tours, run["parcel"], strict=False), "parcelid")
    assert loose[3].PT_wrk_tourend == 2 and math.isclose(loose[3].VMT_wrk_tourend, 15) and loose[2].TNC_wrk_tourend == 1


def test_hot_tour_is_reduced_before_joins(run, spark):
    plan = themes.theme_triptour(*[run[k] for k in ("trip", "tour", "person", "hh", "parcel", "ext")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") == 0 and "ArrowEval" not in plan


def test_telework(run):
    r = rows(themes.theme_telework(run["trip"], run["day"], run["person"], run["hh"]), "hhparcel")
    # person 102 works at home (own parcel) on two days and counts once; part-time person 103 is in no class
    assert (r[1].WKR_NO_TELWK, r[1].WKR_TELWK_FULL) == (1, 0) and math.isclose(r[1].VMT_WKR_NOTELWK, 10 + 5 + 3.6 + 10)
    assert r[1].VMT_WAHWKR == 0 and r[2].WKR_NO_TELWK == 0


def test_external_travel_rates(spark):
    c = spark.createDataFrame
    parcel = c([(1, 50, 10.0, 1.0, 1.0, 4.0), (2, 50, 0.0, 0.0, 0.0, 0.0), (3, 51, 5.0, None, 0.0, 0.0)],
               "parcelid int, taz_p int, emptot_p double, empfoo_p double, empret_p double, empsvc_p double")
    hh = c([(1, 1, 3), (2, 2, 1)], "hhno int, hhparcel int, hhsize int")
    cols = [f"IX_{m}_{e}" for m in ("VT", "VHT", "VMT", "CVMT") for e in "IJ"]
    ixxi = c([(50, *[10.0] * 8, 9.0, 0.0, 0.0, 0.0, 0.0), (51, *[2.0] * 8, 0.0, 0.0, 0.0, 0.0, 0.0), (30, *[500.0] * 8, 9.0, 0.0, 0.0, 0.0, 0.0)],
             "I int, " + ", ".join(f"{x} double" for x in cols) + ", HHS double, EMPTOT double, FOOD double, RET double, SVC double")
    out = rows(themes.theme_external_travel(parcel, hh, ixxi, c([(50, 7), (51, 7), (30, 7)], "taz int, RAD int")), "parcelid")
    # district 7: resident trips 20 * 0.9 over 4 residents; the rest, 24 - 18, over 7 jobs
    assert math.isclose(out[1].IX_VT_RES, 18 / 4 * 3) and math.isclose(out[1].IX_VT, 13.5 + 6) and math.isclose(out[2].IX_VT, 4.5)
    assert out[3].pcl_emp_nretail == 0 and out[3].IX_VT == 0


def test_missing_land_use_gives_zeros(run, spark):
    c = spark.createDataFrame
    zero = lambda key, cols: c([(1, *[5] * len(cols))], f"{key} int, " + ", ".join(f"{x} int" for x in cols))
    pcl = run["parcel"]
    for col in list(combined.PARCEL_AMOUNTS) + list(combined.PARCEL_MINUS_ONE) + ["stugrd_p", "stuhgh_p", "hh_2", "emptot_2", "stugrd_2", "stuhgh_2", "empret_2", "empsvc_2"]:
        if col not in pcl.columns and col != "MIX_DENS":
            pcl = pcl.withColumn(col, F.lit(None).cast("double"))
    out = combined.combined_parcel_table(
        c([(1, 2.0), (2, 3.0)], "PARCELID int, GISAc double"), c([(1, "X")], "PARCELID int, COUNTY string"), pcl,
        zero("parcelid", themes.HOUSEHOLD_COLUMNS), zero("parcelid", themes.PERSON_COLUMNS), zero("parcelid", themes.TRIPTOUR_COLUMNS),
        zero("parcelid", combined.EXTERNAL_KEPT), zero("hhparcel", themes.TELEWORK_COLUMNS)).collect()
    got = {r.GISAc: r for r in out}
    assert got[2.0].PARCELID == 1 and got[2.0].COUNTY == "X" and got[2.0].POP_TOT == 5 and got[2.0].VMT_TOT_RES == 10
    assert got[3.0].PARCELID is None and got[3.0].POP_TOT == 0 and got[3.0].VMT_TOT_RES == 0 and got[3.0].DIST_BUS == -1


# ------------------------------------------------------------------ speeds

def test_congestion(spark):
    c = spark.createDataFrame
    seg = c([("a", 1), ("b", 3)], "tmc string, f_system int").select("*", *[F.lit(x).alias(n) for n, x in (
        ("road", "r"), ("route_numb", 1), ("nhs", 1), ("miles", 2.0), ("cmp_tag", 1), ("direction", "N"))])
    ep = []
    for hour, speed, n in ((23, 60.0, 10), (8, 20.0, 3), (9, 20.0, 3), (10, 40.0, 3), (11, 45.0, 3), (12, 50.0, 3), (13, 10.0, 2)):
        ep += [("a", f"2024-03-05 {hour:02d}:{i:02d}:00", speed, 1.0) for i in range(n)]
    e = c(ep, "tmc_code string, t string, speed double, travel_time_seconds double").withColumn("measurement_tstamp", F.to_timestamp("t"))
    h = {r.hour_of_day: r.hour_rank for r in speeds.ranked_hours(seg, e, 3).collect()}
    assert h == {8: 1, 9: 1, 10: 3, 11: 4, 12: 5, 23: 6}  # 13 h has too few epochs; ties share the rank
    r = rows(speeds.congestion_intensity(seg, e, 3), "tmc")
    assert r["a"].epochs_worst4hrs == 12 and math.isclose(r["a"].havg_spd_worst4hrs, 12 / (6 / 20 + 3 / 40 + 3 / 45)) and r["a"].slowest_hr == 8
    assert r["a"].epochs_night == 10 and r["b"].ff_speed_art60thp == -1 and r["b"].slowest_hr == -1
    d = rows(speeds.congested_hours(seg, e), "tmc")
    assert math.isclose(d["a"].avg_daily_conghrs, 8 * 0.25) and d["b"].avg_daily_hrs_w_data == -1
    p = rows(speeds.period_speed_stats(seg, e), "tmc")
    assert math.isclose(p["a"].avspd_h08, 20.0) and p["a"].epcnt_md5 == 11 and p["b"].epcnt_h08 == 0 and p["b"].avspd_h08 is None
    assert p["a"].epcnt_h07 == 0 and p["a"].stdev_h08 == 0.0


# ------------------------------------------------------------------ network

def test_project_stats_missing_values(spark):
    cols = ["DISTANCE", "LANES", "SPEED", "DAYVMT", "DAYCVMT", "LANEMI", "CAPCLASS"] + [f"{p}{s}" for p in ("A3", "MD", "P3", "EV") for s in ("V", "S", "VMT", "CVMT", "VC")]
    cols += [f"{h}{s}" for h in network.PEAK_HOURS for s in ("V", "VMT", "CVMT", "VC", "SPDGRP")]
    vals = lambda lanes, d: [d if c == "DISTANCE" else lanes if c == "LANES" else 0.0 for c in cols]
    df = spark.createDataFrame([(1, 2, "P", " ", *vals(2.0, 1.0)), (2, 3, "P", " ", *vals(None, 9.0)), (3, 4, "P", None, *vals(4.0, 3.0))],
                               "A int, B int, SACTRAK string, PHASE2 string, " + ", ".join(f"{c} double" for c in cols))
    r = network.project_stats(df).collect()
    assert [x.pjt_id for x in r] == ["P__"] and r[0].LANE_D == 3.5 and r[0].DISTANCE == 13.0 and r[0].VC4h_VMT is None
    m = network.link_metrics(df).first()
    assert m.VC4h == 0 and m.cvmt_p == 0 and m.A_B == "1_2"


# ------------------------------------------------------------------ transit

def test_major_stops(spark):
    c = spark.createDataFrame
    lines = c([("A_A", 3, 2, 10.0, 10.0), ("A_B", 3, 2, 30.0, 10.0), ("B", 3, 2, 15.0, 15.0), ("C", 3, 2, 15.0, 15.1), ("R", 1, 2, 60.0, 60.0), ("T", 3, 4, 0.0, 0.0),
               ("AMTRCC_A", 3, 2, 0.0, 0.0), ("D", 3, 2, 5.0, 5.0)], "line_name string, mode int, color int, headway1 double, headway3 double")
    stops = {"A_A": "1 2 3", "A_B": "3", "B": "2 3", "C": "3", "R": "9", "T": "8", "AMTRCC_A": "7", "D": "2 5", "X": "6"}
    nodes = c([(n, s, i, "Y") for n, t in stops.items() for i, s in enumerate(t.split())] + [("B", "1", 9, "N")], "line_name string, node string, seq int, stop string")
    r = rows(transit.major_transit_stops(lines, nodes, keep_all=True), "node")
    assert (r["2"].hifreq_lines, r["2"].cnt_hifreqlines, r["2"].overlap_warning) == ("A;B;D", 3, "A-B;B-A;")
    assert (r["3"].all_lines, r["3"].hifreq_lines, r["3"].overlap_warning) == ("A;B;C", "A;B", "A-B;B-A;")
    assert r["7"].rail_lines == "AMTRCC" and r["8"].brt_lines == "T" and r["9"].rail_lines == "R" and r["1"].cnt_hifreqlines == 1
    assert r["6"].all_lines == "" and r["6"].overlap_warning == ""
    assert set(rows(transit.major_transit_stops(lines, nodes), "node")) == {"2", "3", "7", "8", "9"}


def test_gtfs(spark):
    c = spark.createDataFrame
    routes = c([("G", "id", "1", "Main")], "agency string, agency_id string, route_id string, route_long_name string")
    cal = c([("G", "wk", 1, 0, 0), ("G", "sa", 0, 1, 0)], "agency string, service_id string, monday int, saturday int, sunday int")
    trips = c([("G", "1", f"t{i}", "0", "sa" if i == 9 else "wk", "s") for i in range(10)],
              "agency string, route_id string, trip_id string, direction_id string, service_id string, shape_id string")
    st = []
    for i, (dep, stops) in enumerate([("06:00", 3), ("06:00", 3), ("07:00", 2), ("04:30", 3), ("22:59", 3), ("26:50", 3), ("12:00", 2), (None, 3), ("08:59", 3), ("06:30", 3)]):
        for k in range(stops):
            t = None if dep is None else f"{int(dep[:2]) + (1 if k == stops - 1 else 0):02d}:{dep[3:]}:00"
            st.append(("G", f"t{i}", t, f"p{k}", k + 1))
    st = c(st, "agency string, trip_id string, departure_time string, stop_id string, stop_sequence int")
    sh = c([("G", "s", i, 38.0, -121.0 + i / 100) for i in range(3)], "agency string, shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double")
    r = gtfs_summary.gtfs_line_summary(routes, trips, st, cal, sh).first()
    assert r.uniq_rte_name == "G1_A" and (r.tripcnt_1, r.first_dep1, r.second_dep1, r.iheadway_1) == (4, 360, 360, 0) and r.avgheadway_1 == 60
    assert r.vsh_1 == 4.0 and r.avg_trpdur1 == 60.0 and abs(r.vsm1 - 4 * 1.089) < 0.01 and abs(r.avg_speed1 - 1.089) < 0.01
    assert r.tripcnt_2 == 1 and r.second_dep2 is None and r.avg_trpdur2 == 60.0  # only a partial run: falls back to all runs
    assert r.tripcnt_3 is None and r.tripcnt_5 == 1 and r.first_dep5 == 1379


# ------------------------------------------------------------------ spatial plans

def test_conflate(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    pts = "array<struct<x:double,y:double>>"
    links = spark.createDataFrame([(1, 1, line((0, 0), (100, 0))), (2, 2, line((0, 0), (100, 0))), (3, 6, line((0, 0), (100, 0))), (4, 2, line((0, 2000), (70, 2070))),
                                   (5, 2, line((0, 5000), (100, 5000))), (6, 1, line((0, 8000), (100, 8000)))], f"link_id int, capc int, points {pts}")
    segs = spark.createDataFrame([("f", 1, 1.0, "F", line((0, 400), (100, 400))), ("a", 2, 1.0, "A", line((0, 300), (100, 300))), ("d", 2, 1.0, "D", line((0, 2010), (69, 2080))),
                                  ("e1", 2, 2.0, "E", line((0, 5100), (100, 5100))), ("e2", 2, 2.0, "E", line((0, 4900), (100, 4900))), ("w", 1, 3.0, "W", line((0, 8900), (100, 8900)))],
                                 f"seg_id string, fwytag int, miles double, roadname string, points {pts}")
    r = rows(conflation.conflate(links, segs), "link_id")
    assert (r[1].seg_id, r[1].search_dist_ft) == ("f", 500) and (r[2].seg_id, r[2].distance) == ("a", 300.0) and r[3].seg_id is None and r[3].search_dist_ft is None
    assert r[4].seg_id == "d" and r[4].search in (1, 2) and r[5].tied and r[5].seg_id == "e1"
    assert (r[6].seg_id, r[6].search, r[6].search_dist_ft, r[6].seg_roadname) == ("w", 3, 1000, "W")
    assert tuple(conflation.conflation_summary(conflation.conflate(links, segs)).first()) == (6, 5, 5, 100.0)


def test_zones(spark):
    box = lambda i, x0, y0, x1, y1: (i, float(x0), float(y0), float(x1), float(y1))
    ring = lambda df, n: df.withColumn(n, G.box_ring("x0", "y0", "x1", "y1"))
    p = ring(spark.createDataFrame([box(1, 0, 0, 2, 2), box(2, 3, 0, 5, 2), box(3, 50, 50, 51, 51)], "parcelid int, x0 double, y0 double, x1 double, y1 double"), "part_ring")
    z = ring(spark.createDataFrame([box(1, 0, 0, 4, 9), box(2, 4, 0, 9, 9), box(3, 20, 20, 21, 21)], "zone_id int, x0 double, y0 double, x1 double, y1 double"), "zone_ring")
    d = spark.createDataFrame([(1, 10.0), (2, 4.0), (3, None)], "parcelid int, v double").withColumn("w", F.col("v"))
    r = rows(zones.aggregate_to_zones(p, d, z, {"v": ("SUMV", "SUM"), "w": ("AVGW", "MEAN")}, 5.0), "zone_id")
    assert (r[1].SUMV, r[1].AVGW, r[2].SUMV, r[3].SUMV) == (12.0, 6.0, 2.0, None)


def test_zone_values_go_with_the_parcels(spark):
    """Values come to the parcels before these meet the zones, so that pieces are not shuffled by parcel. Values and parcels that come twice count twice."""
    shape = "array<struct<x:double,y:double>>"
    ring = lambda x0, y0, x1, y1: [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    p = spark.createDataFrame([(1, ring(0, 0, 2, 2)), (2, ring(3, 0, 5, 2)), (4, ring(6, 0, 7, 1)), (4, ring(6, 0, 7, 1)), (None, ring(0, 4, 1, 5))], f"parcelid int, part_ring {shape}")
    z = spark.createDataFrame([(1, ring(0, 0, 4, 9)), (2, ring(4, 0, 9, 9)), (3, ring(20, 20, 21, 21))], f"zone_id int, zone_ring {shape}")
    d = spark.createDataFrame([(1, 10.0), (1, 2.0), (2, 4.0), (4, 3.0), (None, 9.0)], "parcelid int, v double").withColumn("w", F.col("v"))
    fields = {"v": ("SUMV", "SUM"), "w": ("AVGW", "MEAN")}
    out = zones.aggregate_to_zones(p, d, z, fields, 5.0)
    got = {r.zone_id: (r.SUMV, r.AVGW) for r in out.collect()}
    # zone 1: parcel 1 with 10 and 2, half of parcel 2, one without id; zone 2: half of parcel 2, parcel 4 with twice its area
    assert got == {1: (14.0, 3.5), 2: (8.0, 4.0), 3: (None, None)}
    above = out._jdf.queryExecution().executedPlan().toString().partition("SortMergeJoin")[0]
    assert "HashAggregate" in above and not [x for x in above.splitlines() if "Exchange" in x and "parcelid" in x]
    stored = zones.overlay(p, z, 5.0)
    assert {r.zone_id: (r.SUMV, r.AVGW) for r in zones.aggregate_to_zones(p, d, z, fields, 5.0, pieces=stored).collect()} == got
