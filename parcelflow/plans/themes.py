"""Parcel-level theme tables from model-run tables.

Inputs are the raw run tables (see ``parcelflow.sources.raw_tables``). Each theme brings its detail rows to
one combined aggregate keyed by parcel: rows that count at several parcels (home, work, tour ends) are
listed once per role and aggregated together, so there is a single shuffle on the parcel key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators.aggregates import count_if, rate_then_apply, sum_if
from parcelflow.operators.joins import keep_all


# ------------------------------------------------------------------ households

HOUSEHOLD_COLUMNS = ["HH_TOT_P", "HH_hh", "HH_INC_1", "HH_INC_2", "HH_INC_3", "HH_INC_4", "HH_INC_5",
                     "HH_HD_1", "HH_HD_2", "HH_HD_3", "VEHICLE", "HH_NOVEH", "VEH_AV"]


def theme_household(population: DataFrame, hh: DataFrame, parcel: DataFrame, av: bool = False) -> DataFrame:
    """Households per parcel by income, age of head and vehicles; ``VEH_AV`` counts vehicles of AV households."""
    places = population.select("serialno", "hhcel").distinct()
    heads = population.where("relate = 0").select("serialno", S.band("age", K.HEAD_AGE_EDGES).alias("head")).distinct()
    houses = hh.select(F.col("hhno").alias("serialno"), "hhincome", "hrestype", "hhvehs")
    homes = (places.join(houses, "serialno").join(heads, "serialno", "left")
             .withColumn("head", F.coalesce("head", F.lit(0))).distinct())
    income, head, vehs = S.band("hhincome", K.INCOME_EDGES), F.col("head"), F.col("hhvehs")
    summary = homes.groupBy("hhcel").agg(
        F.count("serialno").alias("HH_TOT_P"),
        count_if(head != 0).alias("HH_hh"),
        *[count_if(income == i).alias(f"HH_INC_{i}") for i in range(1, 6)],
        *[count_if(head == i).alias(f"HH_HD_{i}") for i in range(1, 4)],
        F.sum(F.coalesce(vehs, F.lit(0))).alias("VEHICLE"),
        count_if(vehs == 0).alias("HH_NOVEH"),
        (sum_if(F.col("hrestype") == 1, "hhvehs") if av else F.lit(0).cast("bigint")).alias("VEH_AV"))
    return keep_all(parcel.select("parcelid"), summary, "parcelid", "hhcel", zero=HOUSEHOLD_COLUMNS)


# ------------------------------------------------------------------ persons

PERSON_COLUMNS = ["POP_TOT", "POP_HH", "WKRS_tot", *[f"PPTYP{i}" for i in range(1, 9)],
                  "PPWHT", "PPBLK", "PPHIS", "PPASN", "PPOTH", "WAH", "WKRS_JOBLOCN"]


def theme_person(population: DataFrame, person: DataFrame, parcel: DataFrame) -> DataFrame:
    """Residents per parcel by type, ethnicity and work status, and workers employed at the parcel."""
    p = person.select(F.col("hhno").alias("serialno"), F.col("pno").alias("pnum"), "pptyp", "pwtyp", "pwpcl")
    people = population.select("serialno", "pnum", "hhcel", "ethc", "relate").join(p, ["serialno", "pnum"])
    roles = F.array(F.struct(F.lit(True).alias("home"), F.col("hhcel").alias("at")),
                    F.struct(F.lit(False).alias("home"), F.col("pwpcl").alias("at")))
    rows = people.withColumn("r", F.explode(roles)).where("r.at is not null")
    home = F.col("r.home")
    at_home = lambda p: count_if(home & p)
    ethnic = {"PPWHT": 1, "PPBLK": 2, "PPHIS": 3, "PPASN": 4, "PPOTH": 5}
    summary = rows.groupBy(F.col("r.at").alias("parcelid")).agg(
        count_if(home).alias("POP_TOT"),
        at_home(F.col("relate") != K.DORM_RELATE).alias("POP_HH"),
        at_home(F.col("pwtyp") > 0).alias("WKRS_tot"),
        *[at_home(F.col("pptyp") == i).alias(f"PPTYP{i}") for i in range(1, 9)],
        *[at_home(F.col("ethc") == i).alias(n) for n, i in ethnic.items()],
        at_home(F.col("hhcel") == F.col("pwpcl")).alias("WAH"),
        count_if(~home).alias("WKRS_JOBLOCN"))
    return keep_all(parcel.select("parcelid"), summary, "parcelid", zero=PERSON_COLUMNS)


# ------------------------------------------------------------------ trips and tours

TOUR_MODES = {"SOV": [3], "HOV": [4, 5], "TRN": [6], "BIK": [2], "WLK": [1], "SCB": [8], "TNC": [9]}
WORK_END = ["VMT", "CVMT", "VT", "PT", "SOV", "HOV", "TRN", "BIK", "WLK", "TNC"]
_COUNTED = ["PT", "VT", "SOV", "HOV", "TRN", "BIK", "WLK", "SCB", "TNC"]


def trip_measures(trip: DataFrame, rule: str = "constants") -> DataFrame:
    """Trips summed per tour: counts by mode, vehicle miles and hours, grams of CO2e.

    All later results add these up, so the trip table is reduced to tour rows before any join.
    """
    hours = lambda c: F.col(c).cast("double") / 60
    dist = lambda c: F.col(c).cast("double")
    mode, dorp = F.col("mode"), F.col("dorp")
    drivers = [1, 3] if rule == "dorp_av" else [1]
    veh = lambda v: S.vehicle_share(mode, dorp, v, rule)
    speed = S.trip_speed(mode, hours("timeau"), dist("distau"), hours("travtime"), dist("travdist"))
    t = trip.select("tour_id", "id", "mode", "dorp", "pathtype", hours("travtime").alias("hrs"),
                    veh(dist("distau")).alias("vmt"), veh(dist("distcong")).alias("cvmt"),
                    veh(hours("timeau")).alias("vhr"), S.speed_bin_factor(speed).alias("g"))
    modes = {"SOV": [3], "HOV": [4, 5], "TRN": [6], "BIK": [2], "WLK": [1], "SCB": [8], "TNC": [9]}
    return t.groupBy("tour_id").agg(
        F.count("id").alias("PT"), F.count(F.lit(1)).alias("TRIPS"),
        count_if(mode.isin(K.VEHICLE_MODES) & dorp.isin(drivers)).alias("VT"),
        *[count_if(mode.isin(ms)).alias(n) for n, ms in modes.items()],
        *[count_if(F.col("pathtype") == k).alias(n) for n, k in {"LBUS": 3, "LRT": 4, "EBUS": 5}.items()],
        F.sum("vmt").alias("VMT"), F.sum("cvmt").alias("CVMT"), F.sum("hrs").alias("PHR"), F.sum("vhr").alias("VHR"),
        F.sum(F.when(F.col("g") > 0, F.col("vmt") * F.col("g")).otherwise(F.lit(0.0))).alias("GMI"))


def tour_rows(trip: DataFrame, tour: DataFrame, person: DataFrame, hh: DataFrame, rule: str = "constants") -> DataFrame:
    """One row per tour with trips: tour attributes, home parcel and trip measures.

    The narrow tour, person and household keys are joined first, so the wide trip sums move once, by tour.
    """
    t = tour.select(F.col("id").alias("tour_id"), "person_id", "pdpurp", "parent", "topcl", "tdpcl")
    p = person.select(F.col("id").alias("person_id"), "hhno")
    h = hh.select("hhno", F.col("hhparcel").alias("home"))
    return trip_measures(trip, rule).join(t.join(p, "person_id").join(h, "hhno"), "tour_id")


def _on_work() -> Column:
    return (F.col("pdpurp") == 1) | (F.col("parent") > 0)


def _work_end_aggs(role: Column, prefix: str) -> list[Column]:
    """Work-end sums of one role; VMT and CVMT stay NULL where nothing is known, counts are whole numbers."""
    aggs = [F.sum(F.when(role, F.col(m))).alias(f"{prefix}{m}") for m in WORK_END if m != "PT"]
    pt = F.sum(F.when(role & F.col("home").isNotNull(), F.col("TRIPS")).when(role, F.lit(0))).alias(f"{prefix}PT")
    return aggs + [pt]


def _home_columns() -> list[Column]:
    home, work = F.col("r.role") == "home", _on_work()
    total = lambda m, n: F.sum(F.when(home, F.col(m))).alias(n)
    at_work = lambda m, n: F.sum(F.when(home & work, F.col(m)).when(home, F.lit(0))).alias(n)
    names = ["SOV", "HOV", "TRN", "BIK", "WLK", "TNC"]
    return ([total(m, f"{m}_TOT_RES") for m in ["PT", "VT", *names, "SCB"]]
            + [total(m, f"TRN_{m}_RES") for m in ["LBUS", "LRT", "EBUS"]]
            + [at_work("TRIPS", "PT_WRK_RES"), at_work("VT", "VT_WRK_RES")] + [at_work(m, f"{m}_WRK_RES") for m in names]
            + [total("VMT", "II_VMT_RES"), at_work("VMT", "VMT_WRK_RES"), total("CVMT", "II_CVMT_RES"),
               at_work("CVMT", "CVMT_WRK_RES"), (F.sum(F.when(home, F.col("PHR"))) / 60).alias("PHR_TOT_RES"),
               total("VHR", "VHR_TOT_RES"), at_work("PHR", "PHR_WRK_RES"), at_work("VHR", "VHR_WRK_RES"),
               total("GMI", "GMI_TOT_RES")])


_TRIP_COUNTS = (
    [f"{m}_TOT_RES" for m in ["PT", "VT", "SOV", "HOV", "TRN", "BIK", "WLK", "SCB", "TNC"]]
    + ["TRN_LBUS_RES", "TRN_LRT_RES", "TRN_EBUS_RES", "PT_WRK_RES", "VT_WRK_RES"]
    + [f"{m}_WRK_RES" for m in ["SOV", "HOV", "TRN", "BIK", "WLK", "TNC"]])
# zero, not NULL, for a parcel without trips
_ZERO_WITHOUT_TRIPS = _TRIP_COUNTS + ["VMT_WRK_RES", "CVMT_WRK_RES", "PHR_WRK_RES", "VHR_WRK_RES", "GMI_TOT_RES"]


def _role_rows(tours: DataFrame, subtours_by_origin: bool) -> DataFrame:
    """Each tour once per parcel it counts at: home, and its work end."""
    entry = lambda role, at, p: F.when(p, F.struct(F.lit(role).alias("role"), F.col(at).alias("at")))
    if subtours_by_origin:
        ends = [entry("orig", "topcl", F.col("parent") > 0),
                entry("dest", "tdpcl", (F.col("pdpurp") == 1) & (F.col("parent") == 0))]
    else:
        ends = [entry("dest", "tdpcl", _on_work())]
    roles = F.array(entry("home", "home", F.lit(True)), *ends)
    return tours.withColumn("r", F.explode(F.filter(roles, lambda r: r["at"].isNotNull())))


def _tour_ends(summary: DataFrame, by_origin: bool, strict: bool) -> DataFrame:
    cols = {}
    for m in WORK_END:
        d = F.col(f"d_{m}")
        if not by_origin:
            value = d
        elif strict:
            value = F.coalesce(F.col(f"o_{m}") + d, F.lit(0))
        else:
            value = F.coalesce(F.col(f"o_{m}"), F.lit(0)) + F.coalesce(d, F.lit(0))
        cols[f"{m}_wrk_tourend"] = value
    return summary.withColumns(cols).drop(*[f"{p}_{m}" for p in ("o", "d") for m in WORK_END])


def work_tour_end(tours: DataFrame, parcel: DataFrame, by_origin: bool = True, strict: bool = True) -> DataFrame:
    """Trips and miles at the work end of tours, per parcel.

    Subtours count at their origin, primary work tours at their destination. With ``strict`` a parcel that
    is only one of the two gets 0 throughout (adding a missing side gives NULL, which becomes 0);
    ``strict=False`` takes the missing side as 0. ``by_origin=False`` counts both kinds at the destination.
    """
    role = F.col("r.role")
    aggs = _work_end_aggs(role == "dest", "d_") + (_work_end_aggs(role == "orig", "o_") if by_origin else [])
    rows = _role_rows(tours, by_origin).where(role != "home")
    summary = _tour_ends(rows.groupBy(F.col("r.at").alias("parcelid")).agg(*aggs), by_origin, strict)
    zero = [f"{m}_wrk_tourend" for m in WORK_END] if by_origin else []
    return keep_all(parcel.select("parcelid"), summary, "parcelid", zero=zero)


def tour_summary(tour: DataFrame, hh: DataFrame) -> DataFrame:
    """Tours per home parcel by mode, all and on work tours."""
    mode, work = F.col("tmodetp"), _on_work()
    t = tour.select("hhno", "id", "pdpurp", "parent", "tmodetp").join(hh.select("hhno", "hhparcel"), "hhno")
    return t.groupBy("hhparcel").agg(
        F.count("id").alias("PTO_TOT_RES"), count_if(work).alias("PTO_WRK_RES"),
        *[count_if(mode.isin(ms)).alias(f"PTOUR{n}") for n, ms in TOUR_MODES.items()],
        *[count_if(mode.isin(ms) & work).alias(f"WTOUR{n}") for n, ms in TOUR_MODES.items() if n != "SCB"])


TRIPTOUR_COLUMNS = (
    _TRIP_COUNTS + ["PTO_TOT_RES", "PTO_WRK_RES"]
    + [f"PTOUR{n}" for n in TOUR_MODES] + [f"WTOUR{n}" for n in TOUR_MODES if n != "SCB"]
    + ["II_VMT_RES", "VMT_WRK_RES", "II_CVMT_RES", "CVMT_WRK_RES", "PHR_TOT_RES", "VHR_TOT_RES", "PHR_WRK_RES",
       "VHR_WRK_RES", "GMI_TOT_RES", "JOB_ExWorker"] + [f"{m}_wrk_tourend" for m in WORK_END])


def theme_triptour(trip: DataFrame, tour: DataFrame, person: DataFrame, hh: DataFrame, parcel: DataFrame,
                   external_workers: DataFrame, rule: str = "constants", strict: bool = True) -> DataFrame:
    """Trip, tour, vehicle mile, hour and emission totals per home parcel, and work-end totals.

    ``rule`` is the vehicle share rule: ``constants``, ``dorp`` or ``dorp_av``. The two driver rules count
    work tours and subtours at their destination. ``PHR_TOT_RES`` is divided by 60 once more than
    ``PHR_WRK_RES``; published tables carry that, so it is kept.
    """
    by_origin = rule == "constants"
    rows = _role_rows(tour_rows(trip, tour, person, hh, rule), by_origin)
    role = F.col("r.role")
    aggs = _home_columns() + _work_end_aggs(role == "dest", "d_") + (_work_end_aggs(role == "orig", "o_") if by_origin else [])
    summary = _tour_ends(rows.groupBy(F.col("r.at").alias("parcelid")).agg(*aggs), by_origin, strict)
    tours = tour_summary(tour, hh).withColumnRenamed("hhparcel", "parcelid")
    # a parcel that is only a work end has no home trips: counts are 0 there as for any parcel without trips
    summary = summary.withColumns({c: F.coalesce(F.col(c), F.when(F.col("PT_TOT_RES").isNull(), F.lit(0)))
                                   for c in _ZERO_WITHOUT_TRIPS if c != "PT_TOT_RES"})
    summary = summary.withColumn("PT_TOT_RES", F.coalesce("PT_TOT_RES", F.lit(0)))
    ends = [f"{m}_wrk_tourend" for m in WORK_END] if by_origin else []
    base = parcel.select("parcelid", F.col("taz_p").cast("int").alias("TAZ"), F.col("emptot_p").cast("double").alias("emptot_p"))
    out = keep_all(base, summary, "parcelid", zero=_ZERO_WITHOUT_TRIPS + ends)
    out = out.join(tours, "parcelid", "left")
    ext = external_workers.select(F.col("TAZ").cast("int").alias("TAZ"), F.col("extWkrfraxn").cast("double").alias("f"))
    out = out.join(ext, "TAZ", "left").withColumn("JOB_ExWorker", F.col("emptot_p") * F.col("f"))
    return out.select("parcelid", *TRIPTOUR_COLUMNS)


# ------------------------------------------------------------------ commercial vehicles and external travel

CV_MEASURES = ["VT", "VMT", "CVMT", "VHT"]
CV_COLUMNS = [f"CV{a}_{m}" for a in (2, 3) for m in CV_MEASURES]


def _dbl(c: str) -> Column:
    return F.col(c).cast("double")


def theme_commercial_vehicles(parcel: DataFrame, cveh: DataFrame) -> DataFrame:
    """Zone totals of two- and three-axle vehicles split over parcels by generated trips."""
    retail_food = _dbl("empret_p") + _dbl("empfoo_p")
    others = sum((_dbl(c) for c in ["empgov_p", "empofc_p", "empoth_p", "empsvc_p", "empmed_p", "empind_p"]), _dbl("empedu_p"))
    two = F.lit(K.TWO_AXLE_RATE) * (K.TWO_AXLE_HH * _dbl("hh_p") + K.TWO_AXLE_RETAIL_FOOD * retail_food + K.TWO_AXLE_OTHER * others)
    three = F.lit(K.THREE_AXLE_RATE) * (
        K.THREE_AXLE_HH * _dbl("hh_p") + K.THREE_AXLE_OFFICE * (_dbl("empofc_p") + _dbl("empmed_p") + _dbl("empedu_p"))
        + K.THREE_AXLE_INDUSTRY * (_dbl("empind_p") + _dbl("empoth_p")))
    parts = parcel.select("parcelid", F.col("taz_p").cast("int").alias("TAZ"), two.alias("gen2"), three.alias("gen3"))
    zones = cveh.select(F.col("I").cast("int").alias("TAZ"),
                        *[_dbl(f"C{a}_{m}_I").alias(f"CV{a}_{m}") for a in (2, 3) for m in CV_MEASURES])
    from parcelflow.operators.aggregates import allocate_share
    weights = {f"gen{a}": (f"gen{a}_zone", [f"CV{a}_{m}" for m in CV_MEASURES]) for a in (2, 3)}
    return allocate_share(parts, zones, "TAZ", weights).select("parcelid", "TAZ", *CV_COLUMNS)


EXTERNAL_COLUMNS = ["pcl_pop", "pcl_emp_nretail", "pcl_tot_user", *[f"IX_{m}_RES" for m in CV_MEASURES],
                    *[f"IX_{m}" for m in CV_MEASURES]]


def theme_external_travel(parcel: DataFrame, hh: DataFrame, ixxi: DataFrame, taz_rad: DataFrame) -> DataFrame:
    """District rates of external trips per resident and per job, applied to every parcel of the district."""
    pop = hh.groupBy(F.col("hhparcel").alias("parcelid")).agg(F.sum(F.coalesce(_dbl("hhsize"), F.lit(0.0))).alias("pcl_pop"))
    districts = taz_rad.select(F.col("taz").cast("int").alias("TAZ"), "RAD")
    jobs = _dbl("emptot_p") - _dbl("empfoo_p") - _dbl("empret_p") - K.SERVICE_JOB_SHARE * _dbl("empsvc_p")
    units = (parcel.select("parcelid", F.col("taz_p").cast("int").alias("TAZ"), _dbl("emptot_p").alias("emptot"),
                           F.coalesce(jobs, F.lit(0.0)).alias("pcl_emp_nretail"))
             .join(pop, "parcelid", "left").withColumn("pcl_pop", F.coalesce("pcl_pop", F.lit(0.0)))
             .withColumn("pcl_tot_user", F.col("emptot") + F.col("pcl_pop")).join(districts, "TAZ"))
    zone_jobs = _dbl("EMPTOT") - _dbl("FOOD") - _dbl("RET") - K.SERVICE_JOB_SHARE * _dbl("SVC")
    resident = F.try_divide(_dbl("HHS"), 1 + _dbl("HHS") + K.EXTERNAL_JOB_WEIGHT * zone_jobs)
    both = lambda m: _dbl(f"IX_{m}_I") + _dbl(f"IX_{m}_J")
    acts = (ixxi.where(F.col("I") > K.LAST_GATEWAY_ZONE).withColumn("TAZ", F.col("I").cast("int"))
            .join(districts, "TAZ", "left")
            .select("RAD", *[(both(m) * resident).alias(f"res_{m}") for m in CV_MEASURES],
                    *[both(m).alias(f"tot_{m}") for m in CV_MEASURES]))
    sums = acts.groupBy("RAD").agg(*[F.sum(f"res_{m}").alias(f"res_{m}") for m in CV_MEASURES],
                                   *[(F.sum(f"tot_{m}") - F.sum(f"res_{m}")).alias(f"nres_{m}") for m in CV_MEASURES])
    rates = {f"r_{m}": (f"res_{m}", "pcl_pop") for m in CV_MEASURES}
    rates |= {f"n_{m}": (f"nres_{m}", "pcl_emp_nretail") for m in CV_MEASURES}
    out = rate_then_apply(units, sums, "RAD", rates)
    res = lambda m: F.when(F.col("pcl_pop") > 0, F.col(f"r_{m}")).otherwise(F.lit(0.0))
    non = lambda m: F.when(F.col("pcl_tot_user") > 0, F.col(f"n_{m}")).otherwise(F.lit(0.0))
    return out.select("parcelid", "RAD", "pcl_pop", "pcl_emp_nretail", "pcl_tot_user",
                      *[res(m).alias(f"IX_{m}_RES") for m in CV_MEASURES],
                      *[(res(m) + non(m)).alias(f"IX_{m}") for m in CV_MEASURES])


def theme_vehicles_external(parcel, hh, cveh, ixxi, taz_rad) -> DataFrame:
    """Commercial vehicles and external travel side by side, for parcels that have both."""
    return theme_external_travel(parcel, hh, ixxi, taz_rad).join(theme_commercial_vehicles(parcel, cveh), "parcelid")


# ------------------------------------------------------------------ telework

TELEWORK_COLUMNS = ["WKR_NO_TELWK", "WKR_TELWK_PART", "WKR_TELWK_FULL", "VMT_WKR_NOTELWK", "VMT_TELWKR_PART",
                    "VMT_TELWKR_FULL", "VMT_WAHWKR"]


def theme_telework(trip: DataFrame, personday: DataFrame, person: DataFrame, hh: DataFrame) -> DataFrame:
    """Workers and their vehicle miles per home parcel by telework class."""
    miles = trip.select("hhno", "pno", S.vehicle_share("mode", None, _dbl("distau"), "telework").alias("vmt"))
    miles = miles.groupBy("hhno", "pno").agg(F.sum(F.coalesce("vmt", F.lit(0.0))).alias("vmt"))
    days = (personday.select("person_id", F.col("hhno").alias("day_hhno"), "wkathome", "wktours")
            .join(person.select(F.col("id").alias("person_id"), "hhno", "pno", "pwtyp", "pwpcl"), "person_id")
            .join(hh.select(F.col("hhno").alias("day_hhno"), "hhparcel"), "day_hhno"))
    cls = S.telework_class("pwtyp", "pwpcl", "hhparcel", "wkathome", "wktours")
    # one row per person and class; several days of one class count the person once and the miles each day
    people = days.groupBy("hhparcel", "hhno", "pno", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n_days"))
    people = people.join(miles, ["hhno", "pno"], "left").withColumn("vmt", F.coalesce(F.col("vmt") * F.col("n_days"), F.lit(0.0)))
    n = lambda k: count_if(F.col("cls") == k)
    v = lambda k: F.sum(F.when(F.col("cls") == k, F.col("vmt")).otherwise(F.lit(0.0)))
    return people.groupBy("hhparcel").agg(*[a.alias(c) for a, c in zip(
        [n(1), n(2), n(3), v(1), v(2), v(3), v(4)], TELEWORK_COLUMNS)])


def mix_density_column(parcel: DataFrame, hh: str = "hh_2", emp: str = "emptot_2") -> DataFrame:
    """The parcel table with its mix/density class in ``MIX_DENS``."""
    return parcel.drop("MIX_DENS").withColumn("MIX_DENS", S.mix_density(hh, emp).cast("double"))
