"""Scalar column expressions. Every function returns a Column and stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow import constants as K

DAY_NUMBERS = {d: i + 1 for i, d in enumerate(
    ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"])}


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(rules: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """The value of the first rule whose predicate holds."""
    (p, v), *rest = rules
    out = reduce(lambda acc, r: acc.when(r[0], r[1]), rest, F.when(p, v))
    return out if default is None else out.otherwise(default)


# ------------------------------------------------------------------ projections

def band(col, edges: list, closed: str = "left") -> Column:
    """Index 1..n+1 of the band a value falls in; NULL stays NULL.

    ``closed='left'`` puts a value equal to an edge into the upper band, ``'right'`` into the lower.
    """
    c = as_col(col)
    below = (lambda e: c < F.lit(e)) if closed == "left" else (lambda e: c <= F.lit(e))
    rules = [(below(e), F.lit(i + 1)) for i, e in enumerate(edges)]
    return first_match(rules + [(c.isNotNull(), F.lit(len(edges) + 1))])


def vehicle_share(mode, dorp, value, rule: str = "constants") -> Column:
    """Vehicle quantity (miles, hours) behind one person trip.

    ``constants`` fixed occupancy shares, ride-hail by passenger code with deadheading;
    ``dorp`` all of the trip if the person drives (code 1); ``dorp_av`` codes 1 and 3;
    ``telework`` occupancy shares with one ride-hail share.
    """
    m, d, v = as_col(mode), as_col(dorp) if dorp is not None else None, as_col(value)
    zero = F.lit(0.0)
    if rule in ("dorp", "dorp_av"):
        codes = [1] if rule == "dorp" else [1, 3]
        return F.when(m.isin(K.VEHICLE_MODES) & d.isin(codes), v).otherwise(zero)
    rules = [(m == k, v * F.lit(s)) for k, s in K.SHARE_BY_MODE.items()]
    if rule == "telework":
        rules.append((m == K.RIDE_HAIL_MODE, v * F.lit(K.RIDE_HAIL_TELEWORK_SHARE)))
    elif rule == "constants":
        by_share: dict[float, list[int]] = {}
        for code, s in K.RIDE_HAIL_SHARE_BY_PASSENGER_CODE.items():
            by_share.setdefault(s, []).append(code)
        rules += [((m == K.RIDE_HAIL_MODE) & d.isin(codes), v * F.lit(K.RIDE_HAIL_DEADHEAD) * F.lit(s))
                  for s, codes in by_share.items()]
    else:
        raise ValueError(f"unknown vehicle share rule {rule!r}")
    return first_match(rules, zero)


def trip_speed(mode, timeau_hrs, distau, travtime_hrs, travdist, default: float = K.DEFAULT_TRIP_SPEED) -> Column:
    """Miles per hour; in-vehicle values for auto modes, door-to-door otherwise, else the default."""
    m, ta, da, tt, td = map(as_col, (mode, timeau_hrs, distau, travtime_hrs, travdist))
    auto = m.isin(K.AUTO_MODES)
    return first_match([
        (auto & (ta > 0) & (da > 0), F.try_divide(da, ta)),
        (~auto & (tt > 0) & (td > 0), F.try_divide(td, tt)),
    ], F.lit(float(default)))


def speed_bin_factor(speed, edges=None, factors=None) -> Column:
    """Factor of the right-closed speed bin; zero, negative and NULL speeds give 0."""
    edges, factors = edges or K.GHG_SPEED_EDGES, factors or K.GHG_GRAMS_PER_MILE
    s = as_col(speed)
    rules = [(s.isNull() | (s <= 0), F.lit(0.0))]
    rules += [(s <= F.lit(e), F.lit(float(f))) for e, f in zip(edges, factors)]
    return first_match(rules, F.lit(float(factors[-1])))


def telework_class(pwtyp, work_parcel, home_parcel, wkathome, wktours) -> Column:
    """1 commuted, 2 part-day telework, 3 full-day telework, 4 works at home, 0 no worker, -1 other."""
    w, wp, hp, wh, wt = map(as_col, (pwtyp, work_parcel, home_parcel, wkathome, wktours))
    away = (w == 1) & (wp != hp)
    return first_match([
        (away & (wh == 0), F.lit(1)),
        (away & (wh == 4) & (wt > 0), F.lit(2)),
        (away & (wh == 4) & (wt == 0), F.lit(3)),
        ((w == 1) & (wp == hp), F.lit(4)),
        (w == 0, F.lit(0)),
    ], F.lit(-1))


def mix_density(hh, emp, acres: float = K.HALF_MILE_ACRES) -> Column:
    """Nine-level mix/density class around a parcel: 1-3 homes, 4-6 jobs, 7-9 mixed by density; else 0."""
    h, e = as_col(hh).cast("double"), as_col(emp).cast("double")
    total = h + e
    dens = total / F.lit(float(acres))
    share = lambda x: F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(x, total))
    homes, jobs = share(h), share(e)
    mostly_homes, mostly_jobs = homes >= K.MIX_SHARE_CUT, jobs >= K.MIX_SHARE_CUT
    mixed = (homes < K.MIX_SHARE_CUT) & (jobs < K.MIX_SHARE_CUT)
    low, high = K.MIX_DENSITY_CUTS
    levels = [dens <= low, (dens > low) & (dens <= high), dens > high]
    rules = [(g & lv, F.lit(3 * i + j + 1))
             for i, g in enumerate([mostly_homes, mostly_jobs, mixed & (dens > 0)]) for j, lv in enumerate(levels)]
    return first_match(rules, F.lit(0))


def mix_index(hh, terms: list[tuple[float, float, Column]]) -> Column:
    """Weighted balance of activities against households; -1 without households.

    Each term is (weight, beta, amount): weight * min/max of hh*beta and amount. A NULL amount
    leaves NULL, as a comparison with NULL is not true.
    """
    h = as_col(hh).cast("double")

    def balance(beta, x):
        x, hb = as_col(x).cast("double"), h * F.lit(float(beta))
        return F.try_divide(F.when(hb < x, hb).otherwise(x), F.when(hb > x, hb).otherwise(x))

    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * balance(b, x) for w, b, x in terms])
    return F.when(h > 0, total).otherwise(F.lit(-1.0))


def min_distance(a, b, missing: float = -1.0) -> Column:
    """Nearer of two distances, -1 if both are NULL; if only one is NULL the second is returned as is."""
    a, b = as_col(a), as_col(b)
    return first_match([(a.isNull() & b.isNull(), F.lit(missing)), (a < b, a)], b)


def sum_unless_both_null(a, b) -> Column:
    """0 only if both are NULL; otherwise the NULL-propagating sum."""
    a, b = as_col(a), as_col(b)
    return F.when(a.isNull() & b.isNull(), F.lit(0.0)).otherwise(a + b)


def road_utilization(capclass, vc) -> Column:
    """1 under-used, 2 well used, 3 over-used; 0 for classes without a rule."""
    c, v = as_col(capclass), as_col(vc)
    rules = []
    for classes, low, high in K.UTILIZATION_RULES:
        mine = c.isin(classes)
        if low is None:
            rules += [(mine & (v < high), F.lit(2)), (mine & (v >= high), F.lit(3))]
        else:
            rules += [(mine & (v < low), F.lit(1)), (mine & (v <= high), F.lit(2)), (mine & (v > high), F.lit(3))]
    return first_match(rules, F.lit(0))


def congestion_level(am, pm) -> Column:
    """1 low, 2 moderate, 3 high. Moderate is tested first, so one moderate and one high peak give 2."""
    a, p = as_col(am), as_col(pm)
    moderate = lambda x: (x >= K.MODERATE_VC) & (x < K.HIGH_VC)
    return first_match([(moderate(a) | moderate(p), F.lit(2)), ((a >= K.HIGH_VC) | (p >= K.HIGH_VC), F.lit(3))], F.lit(1))


def phasing_code(by_level, fy_level, in_project, new_road, volume_ratio, fy_am_vc, fy_pm_vc) -> Column:
    """Base/future congestion pair as 1..9, +10 on changed roads, +20 on new roads, with overrides 10 and 20."""
    b, f, p, n = map(as_col, (by_level, fy_level, in_project, new_road))
    r, a, m = map(as_col, (volume_ratio, fy_am_vc, fy_pm_vc))
    pair = F.when(b.between(1, 3) & f.between(1, 3), (b - 1) * 3 + f).otherwise(F.lit(0))
    code = pair + first_match([((p == 1) & (n == 0), F.lit(10)), ((p == 1) & (n == 1), F.lit(20))], F.lit(0))
    over = lambda cut: (a > cut) | (m > cut)
    return first_match([((code == 11) & (r > 1.3) & over(0.5), F.lit(10)), ((code > 20) & over(0.7), F.lit(20))], code)


def cardinal_direction(angle) -> Column:
    """N/S/E/W of an angle in degrees where 0 is east."""
    a = as_col(angle)
    return first_match([
        ((a >= -45) & (a < 45), F.lit("E")),
        ((a >= 45) & (a < 135), F.lit("N")),
        ((a >= 135) | (a < -135), F.lit("W")),
        ((a >= -135) & (a < -45), F.lit("S")),
    ], F.lit("unknown"))


def strip_suffix(col, suffixes: list[str]) -> Column:
    return F.regexp_replace(as_col(col), "(" + "|".join(suffixes) + ")$", "")


def direction_tag(direction_id) -> Column:
    """A for direction 0, B for direction 1, anything else as text."""
    d = as_col(direction_id)
    n = d.cast("string").try_cast("double")
    return first_match([(n == 0, F.lit("A")), (n == 1, F.lit("B"))], F.coalesce(d.cast("string"), F.lit("")))


def infer_scalar(col) -> Column:
    """Struct of the kind of a text value (text, real, whole) and its typed value."""
    c = F.trim(as_col(col))
    letters, dotted = c.rlike("[a-zA-Z]"), c.contains(".")
    real, whole = c.try_cast("double"), c.try_cast("bigint")
    kind = first_match([
        (letters, F.lit("text")),
        (dotted & real.isNotNull(), F.lit("real")),
        (~dotted & whole.isNotNull(), F.lit("whole")),
    ], F.lit("text"))
    return F.struct(kind.alias("kind"), F.when(kind == "whole", whole).alias("whole"),
                    F.when(kind == "real", real).alias("real"), F.when(kind == "text", c).alias("text"))


# ------------------------------------------------------------------ predicates and dates

def hour_window(ts, start: int, end: int) -> Column:
    """Hours from ``start`` up to but not including ``end``; wraps over midnight if start > end."""
    h = F.hour(as_col(ts))
    return ((h >= start) | (h < end)) if start > end else ((h >= start) & (h < end))


def weekday_filter(ts, days: list) -> Column:
    """Days by name or by number with Sunday = 1."""
    return F.dayofweek(as_col(ts)).isin([DAY_NUMBERS.get(d, d) for d in days])


def month_filter(ts, months: list[int]) -> Column:
    return F.month(as_col(ts)).isin(months)


def date_parts(ts) -> dict[str, Column]:
    t = as_col(ts)
    return {"hour": F.hour(t), "day_name": F.date_format(t, "EEEE"), "dow": F.dayofweek(t),
            "doy": F.dayofyear(t), "month": F.month(t)}


def weekday_service(monday="monday", saturday="saturday", sunday="sunday") -> Column:
    return (as_col(monday) == 1) & (as_col(saturday) == 0) & (as_col(sunday) == 0)


def is_gateway(*zones) -> Column:
    return reduce(lambda a, b: a | b, [as_col(z) <= K.LAST_GATEWAY_ZONE for z in zones])


def minutes_after_midnight(hhmmss) -> Column:
    """Minutes of ``HH:MM:SS``; hours may pass 24; NULL counts as 00:00:00."""
    p = F.split(F.trim(F.coalesce(as_col(hhmmss), F.lit("00:00:00"))), ":")
    return F.get(p, F.lit(0)).cast("int") * 60 + F.get(p, F.lit(1)).cast("int")


def clock_text(minutes) -> Column:
    m = as_col(minutes)
    h = F.floor(m / 60)
    return F.concat(h.cast("string"), F.lit(":"), F.lpad(F.round(m - h * 60).cast("int").cast("string"), 2, "0"))


def period_of(minutes, periods: dict = None, default: int = K.GTFS_NO_PERIOD) -> Column:
    m = as_col(minutes)
    return first_match([((m >= lo) & (m < hi), F.lit(k)) for k, (lo, hi) in (periods or K.GTFS_PERIODS).items()],
                       F.lit(default))


def hour_period(hour, periods: dict = None) -> Column:
    """Name of the model period an hour of day belongs to."""
    h = as_col(hour)
    return first_match([(h.isin(hrs), F.lit(n)) for n, hrs in (periods or K.MODEL_PERIODS).items()])


# ------------------------------------------------------------------ text and keys

def text_key(*cols, sep: str = "_") -> Column:
    """Trimmed concatenation for display; join on the single columns, the text may be ambiguous."""
    return F.trim(F.concat_ws(sep, *[F.trim(F.coalesce(as_col(c).cast("string"), F.lit(""))) for c in cols]))


def clean_number_text(col) -> Column:
    """Drop a trailing ``.0`` left by float columns."""
    return F.regexp_replace(as_col(col).cast("string"), r"\.0$", "")


def clean_timestamp(col, pattern: str | None = None, fmt: str | None = None, group: int = 1) -> Column:
    """Timestamp cut out of a text by a regular expression; texts shorter than 5 give NULL."""
    c = as_col(col)
    cut = F.regexp_extract(c, pattern, group) if pattern else c
    text = F.when(F.length(c) >= 5, F.when(cut != "", cut))
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def attribute_prefix(col) -> Column:
    return F.regexp_extract(as_col(col), "^[A-Za-z]*", 0)


def attribute_year(col, add: int = 2000) -> Column:
    return F.regexp_extract(as_col(col), "[0-9]+", 0).try_cast("int") + F.lit(add)


def file_version_key(name, modified, ext) -> Column:
    """``name---<UTC time>ext``."""
    utc = F.to_utc_timestamp(as_col(modified), F.current_timezone())
    return F.concat(as_col(name), F.lit(K.VERSION_MARK), F.date_format(utc, K.VERSION_TIME_FORMAT), as_col(ext))


def original_file_name(key) -> Column:
    """Inverse of ``file_version_key``; a key without extension becomes ``.txt``."""
    k = as_col(key)
    dotted = F.regexp_extract(k, r"^(.*)\.([^.]*)$", 1)
    stem = F.when(k.contains("."), dotted).otherwise(k)
    ext = F.when(k.contains("."), F.regexp_extract(k, r"\.([^.]*)$", 1)).otherwise(F.lit("txt"))
    return F.concat(F.substring_index(stem, K.VERSION_MARK, 1), F.lit("."), ext)


def display_number(col) -> Column:
    """Thousands separators from 1,000 up, otherwise two decimals."""
    v = as_col(col).cast("double")
    return F.when(v >= 1000, F.format_number(F.bround(v, 0), 0)).otherwise(F.bround(v, 2).cast("string"))


def coalesce_number(col, default: float = 0.0) -> Column:
    """Number of a text or number column, the default where it is missing or unreadable."""
    return F.coalesce(as_col(col).cast("string").try_cast("double"), F.lit(float(default)))
