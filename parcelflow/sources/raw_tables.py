"""The nine raw tables of a model run: schemas, file names and loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.sources.delimited import read_dat, read_delimited

# --- fixed values: column names and types of the model-run files ---------------------------------
RAW_COLUMNS = {
    "raw_parcel": """
        parcelid INT, xcoord_p INT, ycoord_p INT, sqft_p INT, taz_p SMALLINT, lutype_p SMALLINT, hh_p FLOAT, stugrd_p FLOAT, stuhgh_p
        FLOAT, stuuni_p FLOAT, empedu_p FLOAT, empfoo_p FLOAT, empgov_p FLOAT, empind_p FLOAT, empmed_p FLOAT, empofc_p FLOAT,
        empret_p FLOAT, empsvc_p FLOAT, empoth_p FLOAT, emptot_p FLOAT, parkdy_p FLOAT, parkhr_p FLOAT, ppricdyp FLOAT, pprichrp
        FLOAT, hh_1 FLOAT, stugrd_1 FLOAT, stuhgh_1 FLOAT, stuuni_1 FLOAT, empedu_1 FLOAT, empfoo_1 FLOAT, empgov_1 FLOAT, empind_1
        FLOAT, empmed_1 FLOAT, empofc_1 FLOAT, empret_1 FLOAT, empsvc_1 FLOAT, empoth_1 FLOAT, emptot_1 FLOAT, parkdy_1 FLOAT,
        parkhr_1 FLOAT, ppricdy1 FLOAT, pprichr1 FLOAT, nodes1_1 FLOAT, nodes3_1 FLOAT, nodes4_1 FLOAT, tstops_1 FLOAT, nparks_1
        FLOAT, aparks_1 INT, hh_2 FLOAT, stugrd_2 FLOAT, stuhgh_2 FLOAT, stuuni_2 FLOAT, empedu_2 FLOAT, empfoo_2 FLOAT, empgov_2
        FLOAT, empind_2 FLOAT, empmed_2 FLOAT, empofc_2 FLOAT, empret_2 FLOAT, empsvc_2 FLOAT, empoth_2 FLOAT, emptot_2 FLOAT,
        parkdy_2 FLOAT, parkhr_2 FLOAT, ppricdy2 FLOAT, pprichr2 FLOAT, nodes1_2 FLOAT, nodes3_2 FLOAT, nodes4_2 FLOAT, tstops_2
        FLOAT, nparks_2 FLOAT, aparks_2 INT, dist_lbus FLOAT, dist_ebus FLOAT, dist_crt FLOAT, dist_fry FLOAT, dist_lrt FLOAT,
        dist_park FLOAT, Circ_E1 FLOAT, Circ_E2 FLOAT, Circ_E3 FLOAT, Circ_NE1 FLOAT, Circ_NE2 FLOAT, Circ_NE3 FLOAT, Circ_N1 FLOAT,
        Circ_N2 FLOAT, Circ_N3 FLOAT, Circ_NW1 FLOAT, Circ_NW2 FLOAT, Circ_NW3 FLOAT, Circ_W1 FLOAT, Circ_W2 FLOAT, Circ_W3 FLOAT,
        Circ_SW1 FLOAT, Circ_SW2 FLOAT, Circ_SW3 FLOAT, Circ_S1 FLOAT, Circ_S2 FLOAT, Circ_S3 FLOAT, Circ_SE1 FLOAT, Circ_SE2 FLOAT,
        Circ_SE3 FLOAT
    """,
    "raw_hh": """
        hhno INT, fraction_with_jobs_outside FLOAT, hhsize INT, hhvehs INT, hhwkrs INT, hhftw INT, hhptw INT, hhret INT, hhoad INT,
        hhuni INT, hhhsc INT, hh515 INT, hhcu5 INT, hhincome INT, hownrent INT, hrestype INT, hhparcel INT, zone_id INT, hhtaz INT,
        hhexpfac INT, samptype INT
    """,
    "raw_person": """
        id INT, hhno INT, pno SMALLINT, pptyp SMALLINT, pagey SMALLINT, pgend SMALLINT, pwtyp SMALLINT, pwpcl INT, pwtaz SMALLINT,
        pwautime FLOAT, pwaudist FLOAT, pstyp SMALLINT, pspcl INT, pstaz SMALLINT, psautime FLOAT, psaudist FLOAT, puwmode SMALLINT,
        puwarrp SMALLINT, puwdepp SMALLINT, ptpass SMALLINT, ppaidprk SMALLINT, pdiary SMALLINT, pproxy SMALLINT, psexpfac SMALLINT
    """,
    "raw_personday": """
        id INT, person_id INT, household_day_id INT, hhno INT, pno SMALLINT, day SMALLINT, beghom SMALLINT, endhom SMALLINT, hbtours
        SMALLINT, wbtours SMALLINT, uwtours SMALLINT, wktours SMALLINT, sctours SMALLINT, estours SMALLINT, pbtours SMALLINT, shtours
        SMALLINT, mltours SMALLINT, sotours SMALLINT, retours SMALLINT, metours SMALLINT, wkstops SMALLINT, scstops SMALLINT, esstops
        SMALLINT, pbstops SMALLINT, shstops SMALLINT, mlstops SMALLINT, sostops SMALLINT, restops SMALLINT, mestops SMALLINT,
        wkathome SMALLINT, pdexpfac SMALLINT
    """,
    "raw_tour": """
        id INT, person_id INT, person_day_id INT, hhno INT, pno SMALLINT, day SMALLINT, tour SMALLINT, jtindex SMALLINT, parent
        SMALLINT, subtrs SMALLINT, pdpurp SMALLINT, tlvorig SMALLINT, tardest SMALLINT, tlvdest SMALLINT, tarorig SMALLINT, toadtyp
        SMALLINT, tdadtyp SMALLINT, topcl INT, totaz SMALLINT, tdpcl INT, tdtaz SMALLINT, tmodetp SMALLINT, tpathtp SMALLINT,
        tautotime FLOAT, tautocost FLOAT, tautodist FLOAT, tripsh1 SMALLINT, tripsh2 SMALLINT, phtindx1 SMALLINT, phtindx2 SMALLINT,
        fhtindx1 SMALLINT, fhtindx2 SMALLINT, toexpfac SMALLINT
    """,
    "raw_trip": """
        id INT, tour_id INT, hhno INT, pno SMALLINT, day SMALLINT, tour SMALLINT, half SMALLINT, tseg SMALLINT, tsvid SMALLINT, opurp
        SMALLINT, dpurp SMALLINT, oadtyp SMALLINT, dadtyp SMALLINT, opcl INT, otaz SMALLINT, dpcl INT, dtaz SMALLINT, mode SMALLINT,
        pathtype SMALLINT, dorp SMALLINT, deptm SMALLINT, arrtm SMALLINT, endacttm SMALLINT, travtime FLOAT, travcost FLOAT, travdist
        FLOAT, vot FLOAT, trexpfac SMALLINT, timeau FLOAT, distau FLOAT, distcong FLOAT
    """,
    "raw_cveh": """
        I FLOAT, C2_VT_I FLOAT, C3_VT_I FLOAT, C2_VHT_I FLOAT, C3_VHT_I FLOAT, C2_VMT_I FLOAT, C3_VMT_I FLOAT, C2_CVMT_I FLOAT,
        C3_CVMT_I FLOAT
    """,
    "raw_ixxi": """
        I FLOAT, IX_VT_I FLOAT, IX_VT_J FLOAT, IX_VHT_I FLOAT, IX_VHT_J FLOAT, IX_VMT_I FLOAT, IX_VMT_J FLOAT, IX_CVMT_I FLOAT,
        IX_CVMT_J FLOAT, HHS FLOAT, EMPTOT FLOAT, FOOD FLOAT, RET FLOAT, SVC FLOAT
    """,
    "raw_ixworker": """
        TAZ SMALLINT, IXWkrFraxn FLOAT, extWkrfraxn FLOAT
    """,
}

RAW_SCHEMAS = {kind: T.StructType([T.StructField(name, {"INT": T.IntegerType(), "SMALLINT": T.ShortType(), "FLOAT": T.FloatType()}[type_name], True)
                                   for name, type_name in (column.split() for column in columns.split(","))])
               for kind, columns in RAW_COLUMNS.items()}

# --- fixed values: file names of a run folder ----------------------------------------------------
RAW_FILES = {
    "raw_parcel": "{year}_raw_parcel.txt", "raw_hh": "_household.tsv", "raw_person": "_person.tsv",
    "raw_personday": "_person_day.tsv", "raw_tour": "_tour.tsv", "raw_trip": "_trip_1_1.csv",
    "raw_cveh": "cveh_taz.dbf", "raw_ixxi": "ixxi_taz.dbf", "raw_ixworker": "worker_ixxifractions.dat",
}


def load_raw(spark: SparkSession, run_dir: str, year: int | str, kinds: list[str] | None = None) -> dict[str, DataFrame]:
    """The chosen raw tables of one run folder, typed, as lazy DataFrames."""
    out = {}
    for kind in kinds or list(RAW_SCHEMAS):
        path = f"{run_dir.rstrip('/')}/{RAW_FILES[kind].format(year=year)}"
        schema = RAW_SCHEMAS[kind]
        if path.endswith(".dat"):
            out[kind] = read_dat(spark, path, schema)
        elif path.endswith(".dbf"):
            from parcelflow.sources.dbf import register_dbf
            register_dbf(spark)
            df = spark.read.format("dbf").load(path)
            out[kind] = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        else:
            out[kind] = read_delimited(spark, path, schema)
    return out
