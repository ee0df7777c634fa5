"""Parcel themes, the combined table, topline and their checks."""

from pyspark.sql import functions as F

from checks.domain import view, with_views
from checks.registry import query, r
from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators import aggregates as A
from parcelflow.operators import joins as J
from parcelflow.plans import combined as C
from parcelflow.plans import themes as T


def bands(c, edges, name):
    lo = [None, *edges]
    hi = [*edges, None]
    return [(f"{name}{i}", " AND ".join(x for x in ((f"{c} >= {a}" if a is not None else ""), (f"{c} < {b}" if b is not None else "")) if x))
            for i, (a, b) in enumerate(zip(lo, hi), 1)]


# ------------------------------------------------------------------ households and persons

def household_sql(av, tail=""):
    cnt = lambda p, n: f"count(*) FILTER (WHERE hhno IS NOT NULL AND {p}) AS {n}"
    veh_av = "CAST(coalesce(sum(CASE WHEN hrestype = 1 THEN hhvehs ELSE 0 END), CASE WHEN count(hhno) = 0 THEN 0 END) AS BIGINT)" if av else "CAST(0 AS BIGINT)"
    return f"""
      homes AS (
        SELECT DISTINCT p.hhcel, p.serialno AS hhno, h.hhincome, h.hrestype, h.hhvehs, coalesce(d.head, 0) AS head
        FROM population p JOIN raw_hh h ON h.hhno = p.serialno
        LEFT JOIN (SELECT DISTINCT serialno, CASE WHEN age < 35 THEN 1 WHEN age < 65 THEN 2 ELSE 3 END AS head
                   FROM population WHERE relate = 0) d ON d.serialno = p.serialno),
      theme_hh AS (
        SELECT q.parcelid, count(hhno) AS HH_TOT_P, {cnt('head > 0', 'HH_hh')},
          {', '.join(cnt(p, n) for n, p in bands('hhincome', K.INCOME_EDGES, 'HH_INC_'))},
          {', '.join(cnt(f'head = {i}', f'HH_HD_{i}') for i in (1, 2, 3))},
          CAST(sum(coalesce(hhvehs, 0)) AS BIGINT) AS VEHICLE, {cnt('hhvehs = 0', 'HH_NOVEH')}, {veh_av} AS VEH_AV
        FROM raw_parcel q LEFT JOIN homes ON homes.hhcel = q.parcelid GROUP BY q.parcelid)"""


for _av in (False, True):
    @query("theme_household_av" if _av else "theme_household",
           with_views("WITH " + household_sql(_av) + " SELECT * FROM theme_hh", "population", "raw_hh", "raw_parcel"))
    def _household(spark, sf, av=_av):
        return T.theme_household(view(spark, sf, "population"), view(spark, sf, "raw_hh"), view(spark, sf, "raw_parcel"), av)


def person_sql():
    home = lambda p, n: f"count(*) FILTER (WHERE x.pnum IS NOT NULL AND {p}) AS {n}"
    return f"""
      people AS (SELECT p.hhcel, p.pnum, p.ethc, p.relate, q.pptyp, q.pwtyp, q.pwpcl
                 FROM population p JOIN raw_person q ON q.hhno = p.serialno AND q.pno = p.pnum),
      jobs AS (SELECT pwpcl, count(*) AS n FROM people GROUP BY pwpcl),
      theme_pp AS (
        SELECT c.parcelid, count(x.pnum) AS POP_TOT, {home('x.relate <> 17', 'POP_HH')}, {home('x.pwtyp > 0', 'WKRS_tot')},
          {', '.join(home(f'x.pptyp = {i}', f'PPTYP{i}') for i in range(1, 9))},
          {', '.join(home(f'x.ethc = {i}', n) for n, i in (('PPWHT', 1), ('PPBLK', 2), ('PPHIS', 3), ('PPASN', 4), ('PPOTH', 5)))},
          {home('x.hhcel = x.pwpcl', 'WAH')}, coalesce(max(j.n), 0) AS WKRS_JOBLOCN
        FROM raw_parcel c LEFT JOIN people x ON x.hhcel = c.parcelid LEFT JOIN jobs j ON j.pwpcl = c.parcelid
        GROUP BY c.parcelid)"""


@query("theme_person", with_views("WITH " + person_sql() + " SELECT * FROM theme_pp", "population", "raw_person", "raw_parcel"))
def _person(spark, sf):
    return T.theme_person(view(spark, sf, "population"), view(spark, sf, "raw_person"), view(spark, sf, "raw_parcel"))


# ------------------------------------------------------------------ trips

def share_sql(v, rule, mode="mode", dorp="dorp"):
    if rule.startswith("dorp"):
        codes = "1" if rule == "dorp" else "1, 3"
        return f"CASE WHEN {mode} IN (3, 4, 5, 9) AND {dorp} IN ({codes}) THEN {v} ELSE 0 END"
    hail = (f"WHEN {mode} = 9 THEN {v} * 0.6" if rule == "telework" else
            f"WHEN {mode} = 9 AND {dorp} IN (11, 12, 13, 21, 22, 23) THEN {v} * 1.4 * CASE {dorp} % 10 WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0.25 END")
    return f"CASE WHEN {mode} = 3 THEN {v} WHEN {mode} = 4 THEN {v} * 0.5 WHEN {mode} = 5 THEN {v} * 0.3 {hail} ELSE 0 END"


SPEED_SQL = """CASE WHEN mode IN (3, 4, 5) AND timeau > 0 AND distau > 0 THEN distau / (timeau / 60)
  WHEN mode NOT IN (3, 4, 5) AND travtime > 0 AND travdist > 0 THEN travdist / (travtime / 60) ELSE 20 END"""


def factor_sql(s):
    cases = " ".join(f"WHEN {s} <= {e} THEN {f}" for e, f in zip(K.GHG_SPEED_EDGES, K.GHG_GRAMS_PER_MILE))
    return f"CASE WHEN {s} IS NULL OR {s} <= 0 THEN 0 {cases} ELSE {K.GHG_GRAMS_PER_MILE[-1]} END"


MODES = {"SOV": "3", "HOV": "4, 5", "TRN": "6", "BIK": "2", "WLK": "1", "SCB": "8", "TNC": "9"}


def triptour_sql(rule, strict=True, raw=False):
    codes = "1, 3" if rule == "dorp_av" else "1"
    veh = f"mode IN (3, 4, 5, 9) AND dorp IN ({codes})"
    cnt = lambda p, n: f"count(*) FILTER (WHERE {p}) AS {n}"
    wsum = lambda c, n: f"sum(CASE WHEN work THEN {c} ELSE 0 END) AS {n}"
    home_counts = ([("PT_TOT_RES", "id IS NOT NULL"), ("VT_TOT_RES", veh), ("PT_WRK_RES", "work"), ("VT_WRK_RES", f"work AND {veh}")]
                   + [(f"{n}_TOT_RES", f"mode IN ({m})") for n, m in MODES.items()]
                   + [(f"{n}_WRK_RES", f"work AND mode IN ({m})") for n, m in MODES.items() if n != "SCB"]
                   + [(f"TRN_{n}_RES", f"pathtype = {k}") for n, k in (("LBUS", 3), ("LRT", 4), ("EBUS", 5))])
    end_counts = [("VT", veh), *[(n, f"mode IN ({m})") for n, m in MODES.items() if n != "SCB"]]

    def ends(name, key, where):
        return f"""{name} AS (SELECT {key} AS parcelid, sum(vmt) AS VMT, sum(cvmt) AS CVMT, count(home) AS PT,
            {', '.join(cnt(p, n) for n, p in end_counts)} FROM tt WHERE {where} GROUP BY {key})"""

    by_origin = rule == "constants"
    work_ends = (ends("oe", "topcl", "parent > 0") + ", " + ends("de", "tdpcl", "pdpurp = 1 AND parent = 0") if by_origin
                 else ends("de", "tdpcl", "work"))

    def end_col(m):
        t = "" if m in ("VMT", "CVMT") else "::BIGINT"
        if not by_origin:
            e = f"de.{m}"
        elif strict:
            e = f"coalesce(oe.{m} + de.{m}, 0){t}"
        else:
            e = f"(coalesce(oe.{m}, 0) + coalesce(de.{m}, 0)){t}"
        return f"{r(e) if not t else e} AS {m}_wrk_tourend"

    end_cols = [end_col(m) for m in T.WORK_END]
    zero_if_none = lambda c: f"CASE WHEN hm.home IS NULL THEN 0 ELSE hm.{c} END"
    cols = ["q.parcelid"] + [f"coalesce(hm.{n}, 0) AS {n}" for n, _ in home_counts]
    cols += [f"tr.{n}" for n in ["PTO_TOT_RES", "PTO_WRK_RES"] + [f"PTOUR{n}" for n in MODES] + [f"WTOUR{n}" for n in MODES if n != "SCB"]]
    cols += [f"{r('hm.' + n)} AS {n}" for n in ("II_VMT_RES", "II_CVMT_RES", "PHR_TOT_RES", "VHR_TOT_RES")]
    cols += [f"{r(zero_if_none(n))} AS {n}" for n in ("VMT_WRK_RES", "CVMT_WRK_RES", "PHR_WRK_RES", "VHR_WRK_RES", "GMI_TOT_RES")]
    cols += [f"{r('q.emptot_p * w.extWkrfraxn')} AS JOB_ExWorker"] + end_cols
    cols += ["hm.II_VMT_RES AS exact_VMT", "hm.II_CVMT_RES AS exact_CVMT"] if raw else []
    return f"""
      t0 AS (SELECT t.*, o.pdpurp, o.parent, o.topcl, o.tdpcl, h.hhparcel AS home, (o.pdpurp = 1 OR o.parent > 0) AS work, {SPEED_SQL} AS spd
             FROM raw_trip t JOIN raw_tour o ON t.tour_id = o.id JOIN raw_person p ON o.person_id = p.id JOIN raw_hh h ON p.hhno = h.hhno),
      tt AS (SELECT *, {share_sql('distau', rule)} AS vmt, {share_sql('distcong', rule)} AS cvmt, {share_sql('timeau / 60', rule)} AS vhr,
             {factor_sql('spd')} AS grams FROM t0),
      {work_ends},
      hm AS (SELECT home, {', '.join(cnt(p, n) for n, p in home_counts)},
               sum(vmt) AS II_VMT_RES, {wsum('vmt', 'VMT_WRK_RES')}, sum(cvmt) AS II_CVMT_RES, {wsum('cvmt', 'CVMT_WRK_RES')},
               sum(travtime / 60) / 60 AS PHR_TOT_RES, sum(vhr) AS VHR_TOT_RES, {wsum('travtime / 60', 'PHR_WRK_RES')}, {wsum('vhr', 'VHR_WRK_RES')},
               sum(CASE WHEN grams > 0 THEN vmt * grams ELSE 0 END) AS GMI_TOT_RES FROM tt GROUP BY home),
      tr AS (SELECT h.hhparcel AS parcelid, count(o.id) AS PTO_TOT_RES, {cnt('o.pdpurp = 1 OR o.parent > 0', 'PTO_WRK_RES')},
               {', '.join(cnt(f'o.tmodetp IN ({m})', f'PTOUR{n}') for n, m in MODES.items())},
               {', '.join(cnt(f'o.tmodetp IN ({m}) AND (o.pdpurp = 1 OR o.parent > 0)', f'WTOUR{n}') for n, m in MODES.items() if n != 'SCB')}
             FROM raw_tour o JOIN raw_hh h ON o.hhno = h.hhno GROUP BY h.hhparcel),
      theme_tt AS (SELECT {', '.join(cols)} FROM raw_parcel q LEFT JOIN hm ON hm.home = q.parcelid LEFT JOIN tr ON tr.parcelid = q.parcelid
        {'LEFT JOIN oe ON oe.parcelid = q.parcelid' if by_origin else ''} LEFT JOIN de ON de.parcelid = q.parcelid
        LEFT JOIN raw_ixworker w ON w.TAZ = q.taz_p)"""


TRIP_VIEWS = ("raw_trip", "raw_tour", "raw_person", "raw_hh", "raw_parcel", "raw_ixworker")

for _rule, _name in (("constants", "theme_triptour"), ("dorp", "theme_triptour_driver"), ("dorp_av", "theme_triptour_driver_av")):
    @query(_name, with_views("WITH " + triptour_sql(_rule) + " SELECT * FROM theme_tt", *TRIP_VIEWS))
    def _triptour(spark, sf, rule=_rule):
        return T.theme_triptour(*[view(spark, sf, v) for v in TRIP_VIEWS], rule=rule)

for _strict, _name in ((True, "work_tour_end"), (False, "work_tour_end_filled")):
    _sql = "WITH " + triptour_sql("constants", _strict) + " SELECT parcelid, " + ", ".join(f"{m}_wrk_tourend" for m in T.WORK_END) + " FROM theme_tt"

    @query(_name, with_views(_sql, *TRIP_VIEWS))
    def _work_end(spark, sf, strict=_strict):
        rows = T.tour_rows(*[view(spark, sf, v) for v in TRIP_VIEWS[:4]])
        return T.work_tour_end(rows, view(spark, sf, "raw_parcel"), strict=strict)


@query("vehicle_share", with_views("SELECT id, mode, dorp, " + ", ".join(
    f"{r(share_sql('distau', k))} AS v_{k}" for k in ("constants", "dorp", "dorp_av", "telework")) + " FROM raw_trip", "raw_trip"))
def _vehicle_share(spark, sf):
    return view(spark, sf, "raw_trip").select("id", "mode", "dorp", *[
        S.vehicle_share("mode", "dorp", "distau", k).alias(f"v_{k}") for k in ("constants", "dorp", "dorp_av", "telework")])


@query("trip_speed_emissions", with_views(f"""
   SELECT id, {r('spd')} AS spd, {r(factor_sql('spd'))} AS grams, {r(factor_sql('spd - 20'))} AS shifted FROM (SELECT id, {SPEED_SQL} AS spd FROM raw_trip) t""", "raw_trip"))
def _speed(spark, sf):
    t = view(spark, sf, "raw_trip")
    hours = lambda c: F.col(c) / 60
    t = t.select("id", S.trip_speed("mode", hours("timeau"), "distau", hours("travtime"), "travdist").alias("spd"))
    return t.select("id", "spd", S.speed_bin_factor("spd").alias("grams"), S.speed_bin_factor(F.col("spd") - 20).alias("shifted"))


# ------------------------------------------------------------------ commercial vehicles, external travel, telework

def cv_sql():
    other = " + ".join(f"{c}_p" for c in ("empedu", "empgov", "empofc", "empoth", "empsvc", "empmed", "empind"))
    return f"""
      gen AS (SELECT parcelid, taz_p, 1.23 * (0.25 * hh_p + 0.68 * (empret_p + empfoo_p) + 0.40 * ({other})) AS g2,
                0.90 * (0.003 * hh_p + 0.057 * (empofc_p + empmed_p + empedu_p) + 0.110 * (empind_p + empoth_p)) AS g3 FROM raw_parcel),
      theme_cv AS (SELECT g.parcelid, g.taz_p AS TAZ, {', '.join(
          r(f"CASE WHEN z.s{a} = 0 THEN 0 ELSE g.g{a} / z.s{a} * c.C{a}_{m}_I END") + f" AS CV{a}_{m}" for a in (2, 3) for m in T.CV_MEASURES)}
        FROM gen g JOIN raw_cveh c ON c.I = g.taz_p JOIN (SELECT taz_p, sum(g2) AS s2, sum(g3) AS s3 FROM gen GROUP BY taz_p) z ON z.taz_p = g.taz_p)"""


def ix_sql(raw=False):
    share = "(HHS / (1 + HHS + 1.1 * (EMPTOT - FOOD - RET - 0.25 * SVC)))"
    ms = T.CV_MEASURES
    exact = "".join(f", CASE WHEN u.pop > 0 THEN u.pop * rr_{m} ELSE 0 END AS exact_{m}" for m in ("VMT", "CVMT")) if raw else ""
    return f"""
      u AS (SELECT q.parcelid, q.taz_p, tr.RAD, q.emptot_p, coalesce(q.emptot_p - q.empfoo_p - q.empret_p - 0.25 * q.empsvc_p, 0) AS jobs,
              coalesce(h.n, 0) AS pop
            FROM raw_parcel q LEFT JOIN (SELECT hhparcel, CAST(sum(coalesce(hhsize, 0)) AS DOUBLE) AS n FROM raw_hh GROUP BY hhparcel) h ON h.hhparcel = q.parcelid
            JOIN taz_rad tr ON tr.taz = q.taz_p),
      acts AS (SELECT tr.RAD, {', '.join(f'sum((IX_{m}_I + IX_{m}_J) * {share}) AS r_{m}, sum(IX_{m}_I + IX_{m}_J) AS t_{m}' for m in ms)}
               FROM raw_ixxi x LEFT JOIN taz_rad tr ON tr.taz = x.I WHERE x.I > 30 GROUP BY tr.RAD),
      rates AS (SELECT a.RAD, {', '.join(f"CASE WHEN b.pop > 0 THEN a.r_{m} / b.pop ELSE 0 END AS rr_{m}, CASE WHEN b.jobs > 0 THEN (a.t_{m} - a.r_{m}) / b.jobs ELSE 0 END AS nr_{m}" for m in ms)}
                FROM acts a LEFT JOIN (SELECT RAD, sum(pop) AS pop, sum(jobs) AS jobs FROM u GROUP BY RAD) b ON b.RAD = a.RAD),
      theme_ix AS (SELECT u.parcelid, u.RAD, {r('u.pop')} AS pcl_pop, {r('u.jobs')} AS pcl_emp_nretail, {r('u.emptot_p + u.pop')} AS pcl_tot_user,
          {', '.join(r(f"CASE WHEN u.pop > 0 THEN u.pop * rr_{m} ELSE 0 END") + f" AS IX_{m}_RES" for m in ms)},
          {', '.join(r(f"CASE WHEN u.pop > 0 THEN u.pop * rr_{m} ELSE 0 END + CASE WHEN u.emptot_p + u.pop > 0 THEN u.jobs * nr_{m} ELSE 0 END") + f" AS IX_{m}" for m in ms)}{exact}
        FROM u LEFT JOIN rates ON rates.RAD = u.RAD)"""


@query("theme_commercial_vehicles", with_views("WITH " + cv_sql() + " SELECT * FROM theme_cv", "raw_parcel", "raw_cveh"))
def _cv(spark, sf):
    return T.theme_commercial_vehicles(view(spark, sf, "raw_parcel"), view(spark, sf, "raw_cveh"))


@query("theme_external_travel", with_views("WITH " + ix_sql() + " SELECT * FROM theme_ix", "raw_parcel", "raw_hh", "raw_ixxi", "taz_rad"))
def _ix(spark, sf):
    return T.theme_external_travel(*[view(spark, sf, v) for v in ("raw_parcel", "raw_hh", "raw_ixxi", "taz_rad")])


def telework_sql(person="tw_person", personday="tw_personday"):
    away = "p.pwtyp = 1 AND p.pwpcl <> h.hhparcel"
    vmt = {f: f"sum(CASE WHEN cls = {k} THEN vmt ELSE 0 END)" for f, k in (("VMT_WKR_NOTELWK", 1), ("VMT_TELWKR_PART", 2), ("VMT_TELWKR_FULL", 3), ("VMT_WAHWKR", 4))}
    return f"""
      pt AS (SELECT p.hhno, p.pno, h.hhparcel, CASE WHEN {away} AND d.wkathome = 0 THEN 1 WHEN {away} AND d.wkathome = 4 AND d.wktours > 0 THEN 2
               WHEN {away} AND d.wkathome = 4 AND d.wktours = 0 THEN 3 WHEN p.pwtyp = 1 AND p.pwpcl = h.hhparcel THEN 4 WHEN p.pwtyp = 0 THEN 0 ELSE -1 END AS cls
             FROM {personday} d JOIN {person} p ON p.id = d.person_id JOIN raw_hh h ON h.hhno = d.hhno),
      pv AS (SELECT pt.hhparcel, pt.hhno, pt.pno, pt.cls, sum(coalesce({share_sql('t.distau', 'telework', 't.mode')}, 0)) AS vmt
             FROM pt LEFT JOIN raw_trip t ON t.hhno = pt.hhno AND t.pno = pt.pno GROUP BY ALL),
      theme_tw AS (SELECT hhparcel, count(*) FILTER (WHERE cls = 1) AS WKR_NO_TELWK, count(*) FILTER (WHERE cls = 2) AS WKR_TELWK_PART,
               count(*) FILTER (WHERE cls = 3) AS WKR_TELWK_FULL, {', '.join(r(e) + ' AS ' + f for f, e in vmt.items())} FROM pv GROUP BY hhparcel)"""


@query("theme_telework", with_views("WITH " + telework_sql() + " SELECT * FROM theme_tw", "raw_trip", "tw_personday", "tw_person", "raw_hh"))
def _tw(spark, sf):
    return T.theme_telework(*[view(spark, sf, v) for v in ("raw_trip", "tw_personday", "tw_person", "raw_hh")])


@query("telework_class", with_views("""SELECT p.id, CASE WHEN p.pwtyp = 0 THEN 0 WHEN p.pwtyp <> 1 THEN -1 WHEN p.pwpcl = h.hhparcel THEN 4
     WHEN d.wkathome = 0 THEN 1 WHEN d.wkathome = 4 AND d.wktours > 0 THEN 2 WHEN d.wkathome = 4 AND d.wktours = 0 THEN 3 ELSE -1 END AS cls
     FROM raw_personday d JOIN raw_person p ON p.id = d.person_id JOIN raw_hh h ON h.hhno = p.hhno""", "raw_personday", "raw_person", "raw_hh"))
def _tw_class(spark, sf):
    d, p, h = (view(spark, sf, v) for v in ("raw_personday", "raw_person", "raw_hh"))
    rows = d.select(F.col("person_id").alias("id"), "wkathome", "wktours").join(p, "id").join(h.select("hhno", "hhparcel"), "hhno")
    return rows.select("id", S.telework_class("pwtyp", "pwpcl", "hhparcel", "wkathome", "wktours").alias("cls"))


# ------------------------------------------------------------------ mix, combined table

DENS = "(hh_2 + emptot_2) / 503"


def mixdens_sql():
    share = lambda c: f"CASE WHEN hh_2 + emptot_2 = 0 THEN 0 ELSE {c} / (hh_2 + emptot_2) END"
    return f"""(SELECT *, CAST(CASE WHEN hs >= 0.8 THEN lv WHEN es >= 0.8 THEN lv + 3 WHEN dens > 0 THEN lv + 6 ELSE 0 END AS DOUBLE) AS MIX_DENS
       FROM (SELECT *, CASE WHEN dens <= 8 THEN 1 WHEN dens <= 16 THEN 2 ELSE 3 END AS lv
             FROM (SELECT *, {DENS} AS dens, {share('hh_2')} AS hs, {share('emptot_2')} AS es FROM raw_parcel) a) b)"""


def mixindex_sql():
    def part(w, beta, x):
        return f"{w} * (CASE WHEN {x} IS NULL THEN NULL ELSE least(hh_2 * {beta}, {x}) / greatest(hh_2 * {beta}, {x}) END)"
    return ("CASE WHEN hh_2 > 0 THEN " + " + ".join(part(w, b, x) for w, b, x in (
        (0.1, 1.211, "emptot_2"), (0.3, 0.457, "(stugrd_2 + stuhgh_2)"), (0.3, 0.371, "empret_2"), (0.3, 0.06, "empsvc_2"))) + " ELSE -1 END")


DIST_MIN = "CASE WHEN dist_lbus IS NULL AND dist_lrt IS NULL THEN -1 WHEN dist_lbus < dist_lrt THEN dist_lbus ELSE dist_lrt END"


@query("mix_density", with_views(f"SELECT parcelid, MIX_DENS FROM {mixdens_sql()} q", "raw_parcel"))
def _mix_density(spark, sf):
    return T.mix_density_column(view(spark, sf, "raw_parcel")).select("parcelid", "MIX_DENS")


@query("mix_index_distances", with_views(f"""SELECT parcelid, {r(mixindex_sql())} AS mixindex, {r(DIST_MIN)} AS dist_min,
    {r('CASE WHEN stugrd_p IS NULL AND stuhgh_p IS NULL THEN 0 ELSE stugrd_p + stuhgh_p END')} AS enr FROM raw_parcel""", "raw_parcel"))
def _mix_index(spark, sf):
    p = view(spark, sf, "raw_parcel")
    amounts = {"emptot": F.col("emptot_2"), "students": F.col("stugrd_2") + F.col("stuhgh_2"), "empret": F.col("empret_2"), "empsvc": F.col("empsvc_2")}
    return p.select("parcelid", S.mix_index("hh_2", [(w, b, amounts[k]) for k, (w, b) in K.MIX_INDEX_TERMS.items()]).alias("mixindex"),
                    S.min_distance("dist_lbus", "dist_lrt").alias("dist_min"), S.sum_unless_both_null("stugrd_p", "stuhgh_p").alias("enr"))


COMBINED_VIEWS = ("master", "land_use", "population", "raw_hh", "raw_person", "raw_personday", "raw_tour", "raw_trip", "raw_parcel",
                  "raw_cveh", "raw_ixxi", "raw_ixworker", "taz_rad")


def combined_sql():
    themes = ",".join([household_sql(False), person_sql(), triptour_sql("constants", raw=True), cv_sql(), ix_sql(True), telework_sql("raw_person", "raw_personday")])
    z = lambda a, cs: [f"coalesce({a}.{c}, 0) AS {c}" for c in cs]
    cols = ["e.PARCELID"] + [f"m.{c}" for c in ("XCOORD", "YCOORD", "RAD_07", "TAZ_07", "TPA_20")] + [f"{r('m.GISAc')} AS GISAc"]
    cols += [f"e.{c}" for c in ("COUNTY", "JURIS", "TAZ_21", "DU", "LU")]
    cols += [f"{r('CASE WHEN q.stugrd_p IS NULL AND q.stuhgh_p IS NULL THEN 0 ELSE q.stugrd_p + q.stuhgh_p END')} AS ENR_K12"]
    cols += [f"{r(f'coalesce(q.{c}, 0)')} AS {n}" for c, n in C.PARCEL_AMOUNTS.items()]
    cols += [f"{r(f'coalesce(q.{c}, -1)')} AS {n}" for c, n in C.PARCEL_MINUS_ONE.items()]
    cols += [f"{r('coalesce(' + DIST_MIN + ', NULL)')} AS DIST_MIN", f"{r(mixindex_sql())} AS MIXINDEX"]
    cols += z("h", T.HOUSEHOLD_COLUMNS) + z("p", T.PERSON_COLUMNS) + z("t", [c for c in T.TRIPTOUR_COLUMNS if c != "GMI_TOT_RES"])
    cols += z("x", [c for c in C.EXTERNAL_KEPT]) + z("w", T.TELEWORK_COLUMNS)
    cols += [f"{r(f'coalesce(t.{a}, 0) + coalesce(x.{b}, 0)')} AS {n}" for n, a, b in (
        ("VMT_TOT_RES", "exact_VMT", "exact_VMT"), ("CVMT_TOT_RES", "exact_CVMT", "exact_CVMT"))]
    return f"""WITH {themes}, xc AS (SELECT theme_ix.*, theme_cv.* EXCLUDE (parcelid) FROM theme_ix JOIN theme_cv ON theme_cv.parcelid = theme_ix.parcelid)
      SELECT {', '.join(cols)} FROM master m LEFT JOIN land_use e ON e.PARCELID = m.PARCELID
      LEFT JOIN {mixdens_sql()} q ON q.parcelid = e.PARCELID LEFT JOIN theme_hh h ON h.parcelid = e.PARCELID
      LEFT JOIN theme_pp p ON p.parcelid = e.PARCELID LEFT JOIN theme_tt t ON t.parcelid = e.PARCELID
      LEFT JOIN xc x ON x.parcelid = e.PARCELID LEFT JOIN theme_tw w ON w.hhparcel = e.PARCELID"""


def _run(spark, sf):
    return {v: view(spark, sf, v) for v in COMBINED_VIEWS}


@query("combined_parcel_table", with_views(combined_sql(), *COMBINED_VIEWS))
def _combined(spark, sf):
    return C.combined_from_run(_run(spark, sf))


@query("qa_reconcile", with_views("""
   WITH a AS (SELECT 'parcel' AS check_name, count(*) AS n_rows FROM raw_parcel UNION ALL SELECT 'land_use', count(*) FROM land_use
              UNION ALL SELECT 'master', count(*) FROM master UNION ALL SELECT 'parcel_join', count(*) FROM master m JOIN raw_parcel p ON p.parcelid = m.PARCELID
              JOIN land_use e ON e.PARCELID = p.parcelid),
        b AS (SELECT 'person' AS check_name, count(*) AS n_rows FROM raw_person UNION ALL SELECT 'population', count(*) FROM population
              UNION ALL SELECT 'population_join_person', count(*) FROM population x JOIN raw_person y ON x.serialno = y.hhno AND x.pnum = y.pno
              UNION ALL SELECT 'population_join_master', count(*) FROM population x JOIN master m ON m.PARCELID = x.hhcel)
   SELECT check_name, n_rows, (SELECT max(n_rows) <> min(n_rows) FROM a) AS mismatch, 'parcels' AS check_group FROM a
   UNION ALL SELECT check_name, n_rows, (SELECT max(n_rows) <> min(n_rows) FROM b), 'persons' FROM b""",
   "raw_parcel", "land_use", "master", "raw_person", "population"))
def _qa(spark, sf):
    return C.qa_reconcile(*[view(spark, sf, v) for v in ("master", "land_use", "raw_parcel", "population", "raw_person")])


# ------------------------------------------------------------------ topline

MODE_COUNTS = ", ".join(f"count(*) FILTER (WHERE mode = {k}) AS {n}_trips" for k, n in K.MODE_NAMES.items())
ROADWAY_SQL = f"""SELECT {', '.join(f"{r(f'sum({m})')} AS {m}_tot, {r(f'sum(CASE WHEN A <= 30 OR B <= 30 THEN {m} ELSE 0 END)')} AS {m}_gtwy, "
  f"{r(f'sum(CASE WHEN A <= 30 OR B <= 30 THEN 0 ELSE {m} END)')} AS {m}_nongtwy" for m in ('DAYVMT', 'DAYCVMT'))},
  {r('sum(CASE WHEN CAPCLASS IN (7, 61, 62, 63, 99) THEN 0 ELSE LANEMI END)')} AS lanemi_motveh FROM net_base"""
VMT_PAX = "coalesce(sum(CASE mode WHEN 3 THEN distau WHEN 4 THEN distau * 0.5 WHEN 5 THEN distau * 0.3 END), 0)"


@query("topline_summary", with_views(f"""
   SELECT p.*, h.*, t.*, n.*, {r('v / tot_pop')} AS tot_resvmt_percap, {r('v')} AS tot_vmt_ii, {r('tr')} AS TRN_REVENUHRS FROM (SELECT count(*) AS tot_pop FROM raw_person) p,
     (SELECT CAST(sum(hhsize) AS BIGINT) AS tot_hh_pop FROM raw_hh) h, (SELECT count(*) AS tot_restrips, {MODE_COUNTS} FROM raw_trip) t,
     ({ROADWAY_SQL}) n, (SELECT {VMT_PAX} AS v FROM raw_trip) vv, (SELECT sum(s_acctbal) AS tr FROM supplier) s""", "raw_person", "raw_hh", "raw_trip", "net_base"))
def _topline(spark, sf):
    from checks.domain import table
    transit = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("REVENUHRS"))
    return C.topline_summary(view(spark, sf, "raw_trip"), view(spark, sf, "raw_hh"), view(spark, sf, "raw_person"), view(spark, sf, "net_base"), transit)


@query("topline_display", """
   SELECT field, value FROM (SELECT CASE WHEN a >= 1000 THEN format('{:,}', CAST(round(a) AS BIGINT)) ELSE CAST(round(a, 2) AS VARCHAR) END AS SUM_l_quantity,
     CASE WHEN b >= 1000 THEN format('{:,}', CAST(round(b) AS BIGINT)) ELSE CAST(round(b, 2) AS VARCHAR) END AS SUM_l_extendedprice
     FROM (SELECT sum(l_quantity) AS a, sum(l_extendedprice) AS b FROM lineitem) q) t
   UNPIVOT (value FOR field IN (SUM_l_quantity, SUM_l_extendedprice))""")
def _topline_display(spark, sf):
    from checks.domain import table
    return A.topline_display(A.topline(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("topline_average", f"SELECT {r('avg(l_quantity)')} AS AVG_l_quantity, {r('avg(l_tax)')} AS AVG_l_tax FROM lineitem")
def _topline_avg(spark, sf):
    from checks.domain import table
    return A.topline(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "AVG")


@query("trips_by_mode", with_views(f"""
   SELECT n.mode_name, count(t.id) AS trips, (SELECT count(*) FROM raw_trip) AS total_trips, {r('count(t.id) / (SELECT count(*) FROM raw_trip)')} AS share
   FROM (VALUES {', '.join(f"({k}, '{n}')" for k, n in K.MODE_NAMES.items())}) n(k, mode_name) LEFT JOIN raw_trip t ON t.mode = n.k GROUP BY n.mode_name""", "raw_trip"))
def _by_mode(spark, sf):
    return A.trips_by_mode(view(spark, sf, "raw_trip"))


@query("resident_vmt", with_views(f"""SELECT 'driver' AS method, {r('coalesce(sum(CASE WHEN dorp = 1 THEN distau END), 0)')} AS vmt FROM raw_trip
   UNION ALL SELECT 'passenger_count', {r(VMT_PAX)} FROM raw_trip""", "raw_trip"))
def _res_vmt(spark, sf):
    t = view(spark, sf, "raw_trip")
    return J.union_all([A.resident_vmt(t, method=m).select(F.lit(m).alias("method"), "vmt") for m in ("driver", "passenger_count")])


@query("roadway_totals", with_views(ROADWAY_SQL, "net_base"))
def _roadway(spark, sf):
    return A.roadway_totals(view(spark, sf, "net_base"))


@query("gateway_links", with_views("SELECT (A <= 30 OR B <= 30) AS gateway, count(*) AS n FROM net_base GROUP BY 1", "net_base"))
def _gateways(spark, sf):
    return view(spark, sf, "net_base").groupBy(S.is_gateway("A", "B").alias("gateway")).agg(F.count(F.lit(1)).alias("n"))


@query("coalesce_defaults", with_views("""SELECT parcelid, """ + r("coalesce(dist_lbus, -1)") + " AS DIST_BUS, " + r("coalesce(stugrd_p, 0)") + " AS ENR FROM raw_parcel", "raw_parcel"))
def _defaults(spark, sf):
    return J.coalesce_defaults(view(spark, sf, "raw_parcel"), {"dist_lbus": -1.0, "stugrd_p": 0.0}, {"dist_lbus": "DIST_BUS", "stugrd_p": "ENR"}, ["parcelid"])


@query("calc_field", with_views(f"SELECT parcelid, hh_p + empret_p AS popej, 1 AS one, {r('hh_p * dist_lrt')} AS prod, hh_p AS cop FROM raw_parcel", "raw_parcel"))
def _calc(spark, sf):
    p = view(spark, sf, "raw_parcel")
    p = J.calc_field(p, "popej", "add", "hh_p", "empret_p")
    p = J.calc_field(J.calc_field(p, "prod", "multiply", "hh_p", "dist_lrt"), "cop", "copy", "hh_p")
    return J.calc_field(p, "one", "constant", 1).select("parcelid", "popej", "one", "prod", "cop")
