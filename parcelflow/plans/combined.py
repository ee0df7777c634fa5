"""The combined parcel table, its reconciliation and its topline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import scalars as S
from parcelflow.operators.aggregates import reconcile_counts
from parcelflow.operators.joins import union_all
from parcelflow.plans import themes as T

MASTER_COLUMNS = ["GISAc", "XCOORD", "YCOORD", "Block_20", "BG_20", "BG_10", "TRACT_20", "GEOID_20", "RAD_07", "TAZ_07",
                  "EJ_21", "TPA_20", "TPA_50"]
LAND_USE_COLUMNS = ["COUNTY", "JURIS", "TAZ_21", "ComType3", "ComType5", "SubComTyp", "Opp_area", "DU_BO", "EMP_BO",
                    "PLACETYPE_BO", "EMPHBB", "DU", "LU"]
PARCEL_AMOUNTS = {"stuuni_p": "ENR_UNI", "emptot_p": "EMPTOT", "empedu_p": "EMPEDU", "empfoo_p": "EMPFOOD",
                  "empgov_p": "EMPGOV", "empofc_p": "EMPOFC", "empoth_p": "EMPOTH", "empret_p": "EMPRET",
                  "empsvc_p": "EMPSVC", "empmed_p": "EMPMED", "empind_p": "EMPIND", "parkdy_p": "DAYPARKS"}
PARCEL_MINUS_ONE = {"dist_lbus": "DIST_BUS", "dist_lrt": "DIST_LRT", "nodes1_2": "NODES1H", "nodes3_2": "NODES3H",
                    "nodes4_2": "NODES4H", "MIX_DENS": "MIX_DENS"}
EXTERNAL_KEPT = [f"IX_{m}_RES" for m in T.CV_MEASURES] + [f"IX_{m}" for m in T.CV_MEASURES] + T.CV_COLUMNS


def _parcel_columns() -> list:
    d = lambda c: F.col(c).cast("double")
    students = d("stugrd_2") + d("stuhgh_2")
    amounts = {"emptot": d("emptot_2"), "students": students, "empret": d("empret_2"), "empsvc": d("empsvc_2")}
    return (
        [S.sum_unless_both_null(d("stugrd_p"), d("stuhgh_p")).alias("ENR_K12")]
        + [F.coalesce(d(c), F.lit(0.0)).alias(n) for c, n in PARCEL_AMOUNTS.items()]
        + [F.coalesce(d(c), F.lit(-1.0)).alias(n) for c, n in PARCEL_MINUS_ONE.items()]
        + [S.min_distance(d("dist_lbus"), d("dist_lrt")).alias("DIST_MIN"),
           S.mix_index("hh_2", [(w, b, amounts[k]) for k, (w, b) in K.MIX_INDEX_TERMS.items()]).alias("MIXINDEX")])


def combined_parcel_table(master: DataFrame, land_use: DataFrame, parcel: DataFrame, household: DataFrame,
                          person: DataFrame, triptour: DataFrame, vehicles_external: DataFrame,
                          telework: DataFrame) -> DataFrame:
    """One wide row per master parcel: attributes, themes with missing values as 0, and resident totals.

    Themes join on the land-use table's parcel id, so a master parcel missing there carries only zeros.
    """
    eto = land_use.select(F.col("PARCELID").alias("__pm"), F.col("PARCELID").alias("PARCELID"),
                          *[c for c in LAND_USE_COLUMNS if c in land_use.columns])
    pm = master.select(F.col("PARCELID").alias("__pm"), *[c for c in MASTER_COLUMNS if c in master.columns])
    base = pm.join(eto, "__pm", "left").drop("__pm")
    pcl = T.mix_density_column(parcel).withColumnRenamed("parcelid", "PARCELID")
    out = base.join(pcl, "PARCELID", "left")
    head = [c for c in base.columns]
    out = out.select(*head, *_parcel_columns())
    themed = [(household, "parcelid", T.HOUSEHOLD_COLUMNS), (person, "parcelid", T.PERSON_COLUMNS),
              (triptour, "parcelid", [c for c in T.TRIPTOUR_COLUMNS if c != "GMI_TOT_RES"]),
              (vehicles_external, "parcelid", EXTERNAL_KEPT), (telework, "hhparcel", T.TELEWORK_COLUMNS)]
    cols = []
    for df, key, names in themed:
        out = out.join(df.select(F.col(key).alias("PARCELID"), *names), "PARCELID", "left")
        cols += [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    known = [c for c in out.columns if c not in {n for _, _, ns in themed for n in ns}]
    out = out.select(*known, *cols)
    return out.withColumns({"VMT_TOT_RES": F.col("II_VMT_RES") + F.col("IX_VMT_RES"),
                            "CVMT_TOT_RES": F.col("II_CVMT_RES") + F.col("IX_CVMT_RES")})


def combined_from_run(run: dict[str, DataFrame], av: bool = False, rule: str = "constants") -> DataFrame:
    """All themes and the combined table from the raw run tables, as one lazy plan."""
    r = run
    return combined_parcel_table(
        r["master"], r["land_use"], r["raw_parcel"],
        T.theme_household(r["population"], r["raw_hh"], r["raw_parcel"], av),
        T.theme_person(r["population"], r["raw_person"], r["raw_parcel"]),
        T.theme_triptour(r["raw_trip"], r["raw_tour"], r["raw_person"], r["raw_hh"], r["raw_parcel"], r["raw_ixworker"], rule),
        T.theme_vehicles_external(r["raw_parcel"], r["raw_hh"], r["raw_cveh"], r["raw_ixxi"], r["taz_rad"]),
        T.theme_telework(r["raw_trip"], r["raw_personday"], r["raw_person"], r["raw_hh"]))


def qa_reconcile(master: DataFrame, land_use: DataFrame, parcel: DataFrame, population: DataFrame, person: DataFrame) -> DataFrame:
    """Row counts of the parcel tables and of the person tables with their joins; flagged per group if they differ."""
    pm, eto = master.select(F.col("PARCELID").alias("parcelid")), land_use.select(F.col("PARCELID").alias("parcelid"))
    pcl, pop = parcel.select("parcelid"), population.select(F.col("serialno").alias("hhno"), F.col("pnum").alias("pno"), "hhcel")
    parcels = reconcile_counts({"parcel": pcl, "land_use": eto, "master": pm,
                                "parcel_join": pm.join(pcl, "parcelid").join(eto, "parcelid")})
    people = reconcile_counts({"person": person, "population": pop,
                               "population_join_person": pop.join(person.select("hhno", "pno"), ["hhno", "pno"]),
                               "population_join_master": pop.join(pm, pop.hhcel == pm.parcelid)})
    return parcels.withColumn("check_group", F.lit("parcels")).unionByName(people.withColumn("check_group", F.lit("persons")))


def topline_summary(trips: DataFrame, hh: DataFrame, person: DataFrame, links: DataFrame | None,
                    transit: DataFrame | None = None, revenue_hours: str = "REVENUHRS") -> DataFrame:
    """One row of regional totals: population, trips by mode, resident miles and roadway totals."""
    from parcelflow.operators.aggregates import count_if, resident_vmt, roadway_totals
    spark = trips.sparkSession
    mode = F.col("mode")
    t = trips.agg(F.count(F.lit(1)).alias("tot_restrips"),
                  *[F.coalesce(count_if(mode == k), F.lit(0)).alias(f"{n}_trips") for k, n in K.MODE_NAMES.items()])
    vmt = resident_vmt(trips).withColumnRenamed("vmt", "tot_vmt_ii")
    pop = person.agg(F.count(F.lit(1)).alias("tot_pop"))
    hhpop = hh.agg(F.coalesce(F.sum("hhsize"), F.lit(0)).alias("tot_hh_pop"))
    parts = [pop, hhpop, t, vmt, roadway_totals(links, spark)]
    if transit is not None:
        parts.append(transit.agg(F.coalesce(F.sum(revenue_hours), F.lit(0.0)).alias(f"TRN_{revenue_hours}")))
    types = {f.name: f.dataType for p in parts for f in p.schema.fields}
    long = union_all([p.select(*[F.col(c).cast("double").alias(c) for c in p.columns]).unpivot([], p.columns, "name", "value") for p in parts])
    wide = long.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).cast(t).alias(n) for n, t in types.items()])
    return wide.withColumn("tot_resvmt_percap", F.try_divide("tot_vmt_ii", "tot_pop"))
