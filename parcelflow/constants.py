"""Fixed values. They must equal the planning agency's published parameters for results to match."""

# --- fixed values: grams of CO2e per vehicle mile by speed bin -------------------------------
# Bin upper edges in mph, right closed; the last factor is for speeds above the last edge.
GHG_SPEED_EDGES = [5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60]
GHG_GRAMS_PER_MILE = [1251.4, 937.0, 732.1, 595.8, 504.5, 444.1, 406.1, 385.4, 379.4, 387.0, 408.5, 446.0, 503.3]

# --- fixed values: person-trip to vehicle shares ----------------------------------------------
MODE_NAMES = {1: "walk", 2: "bike", 3: "sov", 4: "hov2", 5: "hov3", 6: "transit", 8: "schoolbus", 9: "tnc"}
AUTO_MODES = [3, 4, 5]
VEHICLE_MODES = [3, 4, 5, 9]
SHARE_BY_MODE = {3: 1.0, 4: 0.5, 5: 0.3}
RIDE_HAIL_MODE = 9
RIDE_HAIL_DEADHEAD = 1.40
RIDE_HAIL_SHARE_BY_PASSENGER_CODE = {11: 1.0, 21: 1.0, 12: 0.5, 22: 0.5, 13: 0.25, 23: 0.25}
RIDE_HAIL_TELEWORK_SHARE = 0.6
DEFAULT_TRIP_SPEED = 20.0

# --- fixed values: household bands ------------------------------------------------------------
INCOME_EDGES = [15000, 30000, 50000, 75000]
HEAD_AGE_EDGES = [35, 65]
DORM_RELATE = 17

# --- fixed values: mix density and mix index --------------------------------------------------
HALF_MILE_ACRES = 503
MIX_SHARE_CUT = 0.8
MIX_DENSITY_CUTS = [8, 16]
MIX_INDEX_TERMS = {"emptot": (0.1, 1.211), "students": (0.3, 0.457), "empret": (0.3, 0.371), "empsvc": (0.3, 0.06)}

# --- fixed values: commercial vehicle trip generation -----------------------------------------
TWO_AXLE_RATE, TWO_AXLE_HH, TWO_AXLE_RETAIL_FOOD, TWO_AXLE_OTHER = 1.23, 0.25, 0.68, 0.40
THREE_AXLE_RATE, THREE_AXLE_HH, THREE_AXLE_OFFICE, THREE_AXLE_INDUSTRY = 0.90, 0.003, 0.057, 0.110
EXTERNAL_JOB_WEIGHT, SERVICE_JOB_SHARE = 1.1, 0.25
LAST_GATEWAY_ZONE = 30

# --- fixed values: speed study ------------------------------------------------------------------
MODEL_PERIODS = {
    "h07": [7], "h08": [8], "h09": [9], "md5": [10, 11, 12, 13, 14], "h15": [15], "h16": [16], "h17": [17],
    "ev2": [18, 19], "n11": [20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6],
}
SURVEY_MONTHS = [3, 4, 5, 10]
SURVEY_DAYS = ["Tuesday", "Wednesday", "Thursday"]
WORKING_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
FREEWAY_SYSTEMS = [1, 2]
FREEWAY_PERCENTILE, ARTERIAL_PERCENTILE = 0.85, 0.60
CONGESTED_RATIO = 0.6
EPOCH_HOURS = 0.25

# --- fixed values: road utilisation -------------------------------------------------------------
# (capacity classes, well-used from, over-used from/after, class when below the first cut)
UTILIZATION_RULES = [
    ([5, 24], None, 0.85),
    ([2, 3, 4, 12, 22], 0.85, 1.1),
    ([1, 6, 16, 26], 0.9, 1.05),
    ([8, 9, 51, 56], 0.5, 0.85),
]
MODERATE_VC, HIGH_VC = 0.90, 1.05
DISABLED_CAPCLASS = 99
NON_ROAD_CAPCLASSES = [7, 61, 62, 63, 99]

# --- fixed values: link matching ----------------------------------------------------------------
LINK_FREEWAY_CLASSES = [1]
LINK_ARTERIAL_CLASSES = [2, 3, 4, 5, 12, 22, 24]
SEGMENT_FREEWAY_CLASSES = [1]
SEGMENT_ARTERIAL_CLASSES = [2]
MATCH_RADIUS_FT = {"fwy": 500, "art": 300}
WIDE_MATCH_RADIUS_FT = {"fwy": 1000, "art": 600}
ANGLE_TOLERANCE_DEG = 10
ZONE_BUFFER_FT = 1320

# --- fixed values: transit ----------------------------------------------------------------------
GTFS_PERIODS = {1: (300, 540), 2: (540, 900), 3: (900, 1080), 4: (1080, 1200), 5: (1200, 1380), 6: (1380, 1600)}
GTFS_NO_PERIOD = 99
GTFS_EARLIEST_START = 300
RAIL_MODE, BRT_COLOR = 1, 4
HIGH_FREQUENCY_MINUTES = 15
DIRECTION_TAGS = ["_A", "_B"]
RAIL_EXCEPTION_LINES = ["AMTRCC_A", "AMTRCC_B", "AMTRCCS_A", "AMTRCCS_B",
                        "ZF_AMTRCCR_A", "ZF_AMTRCCR_B", "ZF_AMTRJPA_A", "ZF_AMTRJPA_B"]
LINE_FILE_ITEMS_PER_ROW = 8

# --- fixed values: run catalogue ----------------------------------------------------------------
RUN_START_FILES = ["gapstats.txt", "timelog.start.txt"]
RUN_END_FILES = ["ixxi_taz.csv", "cveh_taz.csv", "worker_ixxifractions.csv", "ixxi_taz.dbf"]
VERSION_MARK = "---"
VERSION_TIME_FORMAT = "EEE MMM dd yyyy HH-mm-ss "
