"""Grouped aggregates. All of them combine on the map side, so a hot key reaches the shuffle as a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions.scalars import as_col, display_number, vehicle_share
from parcelflow.operators.joins import join_same
from parcelflow.session import materialize


def count_if(predicate: Column) -> Column:
    return F.sum(F.when(predicate, 1).otherwise(0))


def sum_if(predicate: Column, value) -> Column:
    return F.sum(F.when(predicate, as_col(value)).otherwise(0))


def cond_counts(df: DataFrame, keys: list[str], predicates: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[count_if(p).alias(n) for n, p in predicates.items()])


def cond_sums(df: DataFrame, keys: list[str], terms: dict[str, tuple[Column, Column]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[sum_if(p, v).alias(n) for n, (p, v) in terms.items()])


def harmonic_mean(value) -> Column:
    """All rows over the sum of reciprocals. Rows with NULL count; a zero value adds no reciprocal."""
    return F.try_divide(F.count(F.lit(1)), F.sum(F.try_divide(F.lit(1.0), as_col(value))))


def weighted_average(df: DataFrame, keys: list[str], measures: dict[str, tuple[str, str]],
                     extra: list[Column] = ()) -> DataFrame:
    """Sum of value*weight over the sum of weights of rows with a value, per measure, in one pass."""
    aggs = []
    for out, (value, weight) in measures.items():
        v, w = F.col(value), F.col(weight)
        aggs.append(F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w).otherwise(F.lit(0.0)))).alias(out))
    return df.groupBy(*keys).agg(*aggs, *extra)


def allocate_share(parts: DataFrame, totals: DataFrame, key: str, weights: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Split zone totals over parts in proportion to a weight.

    ``weights`` maps a weight column of ``parts`` to (name of its zone sum, measures of ``totals`` it splits).
    A zone whose weights sum to 0 gives 0. The zone sums come from a map-side combined aggregate that is
    written and joined back, not from a window, so a zone with a large part of all rows stays spread over tasks.
    """
    sums = parts.groupBy(key).agg(*[F.sum(w).alias(s) for w, (s, _) in weights.items()])
    zones = materialize(totals.join(sums, key), "zone-totals")
    out = parts.join(zones, key)
    shares = {}
    for w, (s, measures) in weights.items():
        for m in measures:
            shares[m] = F.when(F.col(s) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(w), F.col(s)) * F.col(m))
    return out.withColumns(shares)


def share_of_total(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Each row's share of its group total, through a written aggregate and a join."""
    total = materialize(df.groupBy(*keys).agg(F.sum(value).alias("__total")), "group-totals")
    return join_same(df, total, keys).withColumn(out, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def rate_then_apply(units: DataFrame, activity: DataFrame, group: str, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """Group rates (activity total over unit base, 0 without base) applied to every unit's own base.

    ``rates`` maps an output to (activity column, base column of ``units``).
    """
    bases = sorted({b for _, b in rates.values()})
    base = units.groupBy(group).agg(*[F.sum(b).alias(f"__{b}") for b in bases])
    acts = activity.groupBy(group).agg(*[F.sum(a).alias(f"__{a}") for a in sorted({a for a, _ in rates.values()})])
    per = acts.join(base, group, "left").select(group, *[
        F.when(F.col(f"__{b}") > 0, F.try_divide(F.col(f"__{a}"), F.col(f"__{b}"))).otherwise(F.lit(0.0)).alias(f"__r_{o}")
        for o, (a, b) in rates.items()])
    per = materialize(per, "rates")  # its true size known, a few groups don't make the units move
    out = units.join(per, group, "left").withColumns({o: F.col(f"__r_{o}") * F.col(b) for o, (_, b) in rates.items()})
    return out.drop(*[f"__r_{o}" for o in rates])


def two_level(df: DataFrame, inner_keys: list[str], inner: list[Column], outer_keys: list[str],
              outer: list[Column]) -> DataFrame:
    """Aggregate of an aggregate, e.g. the average over days of a daily sum."""
    return df.groupBy(*inner_keys).agg(*inner).groupBy(*outer_keys).agg(*outer)


def having_at_least(df: DataFrame, keys: list[str], n: int, aggs: list[Column]) -> DataFrame:
    """Groups with at least ``n`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *aggs).where(F.col("__n") >= n).drop("__n")


def distinct_count(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact distinct count as two map-side combined steps, so that one hot group is spread by value."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.count(value).alias(out))


def joined_names(name, predicate: Column | None = None, sep: str = ";") -> Column:
    """Sorted, separated text of the names whose predicate holds; empty text if there are none."""
    n = as_col(name)
    picked = F.when(predicate, n) if predicate is not None else n
    return F.coalesce(F.array_join(F.sort_array(F.collect_set(picked)), sep), F.lit(""))


def topline(df: DataFrame, fields: list[str], op: str = "SUM") -> DataFrame:
    """Grand totals of chosen fields with a selectable aggregate."""
    return df.agg(*[F.expr(f"{op}(`{c}`)").alias(f"{op}_{c}") for c in fields])


def topline_display(df: DataFrame) -> DataFrame:
    """One (field, value text) row per column of a one-row topline."""
    cols = df.columns
    return df.select(*[display_number(c).alias(c) for c in cols]).unpivot([], cols, "field", "value")


def trips_by_mode(trips: DataFrame, mode: str = "mode", names: dict[int, str] | None = None) -> DataFrame:
    """Trips, total and share per mode name; modes without trips appear with 0."""
    names = names or K.MODE_NAMES
    wide = trips.agg(*[count_if(F.col(mode) == k).alias(n) for k, n in names.items()],
                     F.count(F.lit(1)).alias("total_trips"))
    long = wide.unpivot(["total_trips"], list(names.values()), "mode_name", "trips")
    return long.select("mode_name", F.coalesce("trips", F.lit(0)).alias("trips"), "total_trips",
                       F.try_divide(F.col("trips"), F.col("total_trips")).alias("share"))


def resident_vmt(trips: DataFrame, vmt: str = "distau", method: str = "passenger_count",
                 mode: str = "mode", dorp: str = "dorp") -> DataFrame:
    """Vehicle miles from person trips by occupancy share, or counting drivers only. Missing modes add 0."""
    if method == "driver":
        value = F.when(F.col(dorp) == 1, F.col(vmt))
    elif method == "passenger_count":
        value = F.when(F.col(mode).isin(K.AUTO_MODES), vehicle_share(mode, None, vmt, "telework"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return trips.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("vmt"))


def roadway_totals(links: DataFrame | None, spark=None, measures=("DAYVMT", "DAYCVMT"), a="A", b="B",
                   capclass="CAPCLASS", lane_miles="LANEMI", last_gateway: int = K.LAST_GATEWAY_ZONE) -> DataFrame:
    """Totals over all, gateway and other links, and lane miles of roads. -1 everywhere without a link table."""
    if links is None:
        names = [f"{m}_{s}" for m in measures for s in ("tot", "gtwy", "nongtwy")]
        return spark.range(1).select(*[F.lit(-1.0).alias(n) for n in names])
    gate = (F.col(a) <= last_gateway) | (F.col(b) <= last_gateway)
    aggs = []
    for m in measures:
        tot, inside = F.coalesce(F.sum(m), F.lit(0.0)), F.coalesce(F.sum(F.when(gate, F.col(m))), F.lit(0.0))
        aggs += [tot.alias(f"{m}_tot"), inside.alias(f"{m}_gtwy"), (tot - inside).alias(f"{m}_nongtwy")]
    road = ~F.coalesce(F.col(capclass).isin(K.NON_ROAD_CAPCLASSES), F.lit(False))
    aggs.append(F.coalesce(F.sum(F.when(road, F.col(lane_miles))), F.lit(0.0)).alias("lanemi_motveh"))
    return links.agg(*aggs)


def congested_mile_share(df: DataFrame, group: Column, group_name: str, ratio: str, miles: str,
                         cut: float = K.CONGESTED_RATIO) -> DataFrame:
    """Congested miles over miles with a known ratio, per group."""
    known, slow = F.col(ratio) > 0, (F.col(ratio) > 0) & (F.col(ratio) < cut)
    return (df.groupBy(group.alias(group_name))
            .agg(sum_if(slow, miles).alias("cong_dirmiles"), sum_if(known, miles).alias("tot_dirmiles"))
            .withColumn("pct_cong_dirmiles", F.try_divide("cong_dirmiles", "tot_dirmiles")))


def reconcile_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per named table, with a flag on every row if the counts differ."""
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("check_name"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    # one row per table
    all_rows = counts.agg(F.collect_list(F.struct("check_name", "n_rows")).alias("c"), (F.max("n_rows") != F.min("n_rows")).alias("mismatch"))
    return all_rows.select(F.inline("c"), "mismatch")


def match_rate(links: DataFrame, link_class: str, matched: str, taggable: list) -> DataFrame:
    """Links, taggable links, tagged links and the rounded percentage."""
    can = F.col(link_class).isin(taggable)
    out = links.agg(F.count(F.lit(1)).alias("total_links"), count_if(can).alias("taggable_links"),
                    count_if(can & F.col(matched).isNotNull()).alias("tagged_links"))
    return out.withColumn("pct_tagged", F.bround(F.try_divide(F.col("tagged_links") * 100, F.col("taggable_links")), 0))


def totals_by_part(data: DataFrame, part: str, fields: list[str]) -> DataFrame:
    """(part, fields, n_rows): what ``area_weighted`` needs of the values, one row a part."""
    return data.groupBy(part).agg(*[F.sum(F.col(f).cast("double")).alias(f) for f in fields], F.count(F.lit(1)).alias("n_rows"))


def area_weighted(pieces: DataFrame, data: DataFrame | None, zones: DataFrame, part: str, zone: str,
                  fields: dict[str, tuple[str, str]], piece_area="piece_area", part_area="part_area", n_rows: str = "n_rows") -> DataFrame:
    """Values times the piece's share of its part's area (missing values count 0), SUM or MEAN per zone, all zones kept.

    Without ``data`` the pieces hold the columns of ``totals_by_part``, so that they meet no table and are not shuffled before they are added up.
    """
    share = F.try_divide(F.col(piece_area), F.col(part_area))
    joined = pieces if data is None else pieces.select(part, zone, piece_area, part_area).join(totals_by_part(data, part, [*fields]).withColumnRenamed("n_rows", n_rows), part, "left")
    # a piece counts for a mean as often as its part has rows, or once if it has none
    rows = F.sum(F.coalesce(F.col(n_rows), F.lit(1)))
    how = {"SUM": lambda total: total, "MEAN": lambda total: F.try_divide(total, rows)}
    sums = joined.groupBy(zone).agg(*[
        how[op](F.sum(F.coalesce(F.col(f) * share, F.lit(0.0)))).alias(out) for f, (out, op) in fields.items()])
    return zones.select(zone).join(sums, zone, "left")


def first_changed_year(df: DataFrame, keys: list[str], attributes: list[str], base_year: int, keep_version: str = "DPS",
                       century: int = 2000) -> DataFrame:
    """First year in which an attribute differs from its base-year value, one column per attribute.

    Yearly columns are named attribute, two-digit year and optionally a version; where a column has a
    version only ``keep_version`` counts. The comparison stays on the row, so nothing is shuffled.
    """
    import re
    outs = []
    for a in attributes:
        base = F.col(f"{a}{base_year:02d}")
        years = []
        for c in df.columns:
            m = re.fullmatch(rf"{a}(\d+)(_.*)?", c)
            if m and int(m.group(1)) >= base_year and (m.group(2) is None or keep_version in m.group(2)):
                years.append(F.when(~F.col(c).eqNullSafe(base), F.lit(int(m.group(1)) + century)))
        outs.append(F.array_min(F.array(*years)).alias(f"{a}_changeyears"))
    return df.select(*keys, *outs)
