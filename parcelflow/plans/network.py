"""Model network links: metrics, base/future comparison, project totals, years of change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators.aggregates import first_changed_year, weighted_average
from parcelflow.operators.joins import base_future

PEAK_HOURS = ["H07", "H08", "H16", "H17"]


def link_metrics(net: DataFrame) -> DataFrame:
    """Four-hour volumes and miles, volume-weighted V/C and speed, peak V/C, congested share, utilisation, keys."""
    total = lambda sfx: sum((F.col(h + sfx) for h in PEAK_HOURS[1:]), F.col(PEAK_HOURS[0] + sfx))
    mean = lambda sfx: sum((F.col(h + sfx) * F.col(h + "V") for h in PEAK_HOURS[1:]), F.col(PEAK_HOURS[0] + sfx) * F.col(PEAK_HOURS[0] + "V"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    v4 = F.col("V4h")
    per_volume = lambda sfx: F.when(v4 != 0, F.try_divide(mean(sfx), v4)).otherwise(F.lit(0.0))
    out = net.withColumns({
        "A_B": S.text_key("A", "B"), "pjt_id": F.trim(F.concat(text("SACTRAK"), F.lit("__"), text("PHASE2"))),
        "V4h": total("V"), "VMT4h": total("VMT"), "CVMT4h": total("CVMT"),
        "congmapvc": F.when(F.col("A3VC") >= F.col("P3VC"), F.col("A3VC")).otherwise(F.col("P3VC")),
        "cvmt_p": F.when(F.col("DAYVMT") > 0, F.try_divide("DAYCVMT", "DAYVMT")).otherwise(F.lit(0.0)),
        "conglev": S.congestion_level("A3VC", "P3VC")})
    return out.withColumns({"VC4h": per_volume("VC"), "CSPD4h": per_volume("SPDGRP"),
                            "rd_util": S.road_utilization("CAPCLASS", "congmapvc")})


COMPARED = ["LANES", "CAPCLASS", "SPEED", "BIKE", "LANEMI", "A3V", "MDV", "P3V", "A3S", "P3S", "EVS", "DYV", "DAYVMT", "DAYCVMT",
            "A3VC", "P3VC", "V4h", "VMT4h", "CVMT4h", "VC4h", "CSPD4h", "congmapvc", "cvmt_p", "rd_util", "conglev"]
DESCRIPTIVE = ["NAME", "DISTANCE", "SCREEN", "RAD", "HWYSEG", "TRAV_DIR", "FWYID", "COUNTID", "SACTRAK", "PHASE2", "pjt_id"]


def change_flags(df: DataFrame) -> DataFrame:
    """Ratios (0 without base), new (1) and deleted (2) roads, differences, project marks."""
    ratio = lambda c: F.when(F.col(f"BY{c}") > 0, F.try_divide(f"FY{c}", f"BY{c}")).otherwise(F.lit(0.0))
    fy, by = F.col("FYCAPCLASS"), F.col("BYCAPCLASS")
    off = K.DISABLED_CAPCLASS
    diff = lambda c: F.col(f"FY{c}") - F.col(f"BY{c}")
    df = df.withColumns({
        "fybydyv_p": ratio("DYV"), "fybylanes": ratio("LANES"),
        "newroad": S.first_match([((fy < off) & (by == off), F.lit(1)), ((fy == off) & (by < off), F.lit(2))], F.lit(0)),
        "delta_lanes": diff("LANES"), "delta_day": diff("DYV"), "delta_dvmt": diff("DAYVMT"), "delta_dcvmt": diff("DAYCVMT"),
        "proj": F.when(F.col("SACTRAK").eqNullSafe(" ") & F.col("PHASE2").eqNullSafe(" "), 0).otherwise(1)})
    return df.withColumn("proj_IN", F.when((F.col("delta_lanes") > 0) | (fy != by), 1).otherwise(0))


def link_compare(base: DataFrame, future: DataFrame) -> DataFrame:
    """Links present in both years with BY/FY columns, changes, and a phasing code."""
    b, f = link_metrics(base), link_metrics(future)
    joined = base_future(b.select("A", "B", *[c for c in COMPARED if c in b.columns]),
                         f.select("A", "B", "A_B", *[c for c in DESCRIPTIVE + COMPARED if c in f.columns]), ["A", "B"], ["A_B", *DESCRIPTIVE])
    out = change_flags(joined.drop("A", "B"))
    return out.withColumn("phasing", S.phasing_code("BYconglev", "FYconglev", "proj_IN", "newroad", "fybydyv_p", "FYA3VC", "FYP3VC"))


PROJECT_SUMS = ["DISTANCE", "LANEMI", "DAYVMT", "DAYCVMT", "VMT4h", "CVMT4h", "A3VMT", "MDVMT", "P3VMT", "EVVMT",
                "A3CVMT", "MDCVMT", "P3CVMT", "EVCVMT"]
PROJECT_MEANS = {
    "LANE_D": ("LANES", "DISTANCE"), "SPD_D": ("SPEED", "DISTANCE"), "CSPD4h_D": ("CSPD4h", "DISTANCE"),
    "CSPD4h_VMT": ("CSPD4h", "VMT4h"), "VC4h_D": ("VC4h", "DISTANCE"), "VC4h_VMT": ("VC4h", "VMT4h"),
    "A3VC_D": ("A3VC", "A3VMT"), "P3VC_D": ("P3VC", "P3VMT"), "EVVC_D": ("EVVC", "EVVMT"),
    "A3VC_VMT": ("A3VC", "DISTANCE"), "P3VC_VMT": ("P3VC", "DISTANCE"), "EVVC_VMT": ("EVVC", "DISTANCE"),
    "A3S_VMT": ("A3S", "A3VMT"), "P3S_VMT": ("P3S", "P3VMT"), "EVS_VMT": ("EVS", "EVVMT")}


def project_stats(net: DataFrame) -> DataFrame:
    """Sums and weighted means per project in one pass. The published names of V/C weights are kept as they are."""
    m = link_metrics(net).withColumns({c: F.col(c).cast("string").try_cast("double") for c in ("LANES", "SPEED")})
    return weighted_average(m, ["pjt_id"], PROJECT_MEANS, [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in PROJECT_SUMS])


def project_compare(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """Per project in both networks: BY, SN, difference (dif) and relative difference (ptc) of every measure."""
    b, s = project_stats(base), project_stats(scenario)
    cols = [*PROJECT_SUMS, *PROJECT_MEANS]
    z = lambda df, p: df.select("pjt_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(p + c) for c in cols])
    j = z(b, "BY").join(z(s, "SN"), "pjt_id")
    dif = lambda c: F.col(f"SN{c}") - F.col(f"BY{c}")
    return j.select("*", *[dif(c).alias(f"dif{c}") for c in cols], *[F.try_divide(dif(c), F.col(f"BY{c}")).alias(f"ptc{c}") for c in cols])


def attribute_change_years(links: DataFrame, base_year: int = 16, attributes=("SPD", "CAPC", "LANE", "BIKE"),
                           keep_version: str = "DPS") -> DataFrame:
    """First change year per attribute for links that carry a project id."""
    picked = links.where(F.col("SACTRAK") != "")
    return first_changed_year(picked, ["A", "B", "SACTRAK", "PHASE2"], list(attributes), base_year, keep_version)
