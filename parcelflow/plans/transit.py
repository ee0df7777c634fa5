"""Transit lines: major stops, link checks, line features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import geometry as G
from parcelflow.functions import scalars as S
from parcelflow.operators import joins, spatial, windows
from parcelflow.operators.aggregates import count_if, joined_names
from parcelflow.session import materialize


def major_transit_stops(lines: DataFrame, nodes: DataFrame, hf_minutes: float = K.HIGH_FREQUENCY_MINUTES,
                        keep_all: bool = False) -> DataFrame:
    """Stops served by rail, by bus rapid transit, or by two or more frequent lines, with the line names.

    ``overlap_warning`` names the pairs of frequent lines at a stop of which one serves only stops of the other.
    """
    nodir = S.strip_suffix("line_name", K.DIRECTION_TAGS).alias("line")
    attrs = ["mode", "color", "headway1", "headway3"]
    svc = lines.select(nodir, *attrs).groupBy("line").agg(*[F.min(c).alias(c) for c in attrs])
    stops = nodes.where("stop = 'Y'").select(nodir, "node").distinct()
    served = stops.join(svc, "line")
    exceptions = sorted({n[:-2] if n[-2:] in K.DIRECTION_TAGS else n for n in K.RAIL_EXCEPTION_LINES})
    rail = F.coalesce((F.col("mode") == K.RAIL_MODE) | F.col("line").isin(exceptions), F.lit(False))
    brt = F.coalesce(F.col("color") == K.BRT_COLOR, F.lit(False))
    often = lambda c: (F.col(c) > 0) & (F.col(c) <= hf_minutes)
    frequent = ~rail & ~brt & F.coalesce(often("headway1") & often("headway3"), F.lit(False))
    served = materialize(served.withColumns({"rail": rail, "brt": brt, "hf": frequent}), "served-stops")  # used three times
    per = served.groupBy("node").agg(
        joined_names("line").alias("all_lines"), joined_names("line", F.col("rail")).alias("rail_lines"),
        joined_names("line", F.col("brt")).alias("brt_lines"), joined_names("line", F.col("hf")).alias("hifreq_lines"),
        count_if(F.col("hf")).alias("cnt_hifreqlines"))
    # every stop appears, also one whose lines have no attributes
    out = joins.keep_all(stops.select("node").distinct(), per, "node", zero=["cnt_hifreqlines"])
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("all_lines", "rail_lines", "brt_lines", "hifreq_lines")})
    out = out.join(overlap_warnings(served, out), "node", "left").withColumn("overlap_warning", F.coalesce("overlap_warning", F.lit("")))
    if keep_all:
        return out
    return out.where((F.col("rail_lines") != "") | (F.col("brt_lines") != "") | (F.col("cnt_hifreqlines") > 1))


def overlap_warnings(served: DataFrame, per_stop: DataFrame) -> DataFrame:
    """``a-b;`` for each ordered pair of frequent lines at a stop where one line's stops contain the other's."""
    hf = served.where("hf").select("line", "node")
    pairs = joins.contained_sets(hf, "line", "node")
    bus_only = per_stop.where((F.col("rail_lines") == "") & (F.col("brt_lines") == "") & (F.col("cnt_hifreqlines") > 1)).select("node")
    at_a = pairs.join(hf.withColumnRenamed("line", "a"), "a")
    at_both = at_a.join(hf.withColumnRenamed("line", "b"), ["b", "node"]).join(bus_only, "node", "left_semi")
    text = F.concat("a", F.lit("-"), "b", F.lit(";"))
    return at_both.groupBy("node").agg(F.array_join(F.sort_array(F.collect_set(text)), "").alias("overlap_warning"))


def check_transit_links(lines: DataFrame, nodes: DataFrame, links: DataFrame, rail_modes=(K.RAIL_MODE,)) -> DataFrame:
    """Consecutive node pairs of non-rail lines that are not directed links of the road network."""
    bus = lines.where(~F.coalesce(F.col("mode").isin(list(rail_modes)), F.lit(False))).select("line_name")
    on_road = nodes.join(bus, "line_name", "left_semi").select("line_name", "seq", F.abs(F.col("node").cast("bigint")).alias("node"))
    pairs = windows.consecutive_pairs(on_road, ["line_name"], "seq", "node")
    checked = joins.pair_status(pairs, links)
    return checked.where("LINK_HWYNET_STATUS <> 'OK'").select(F.col("line_name").alias("NAME"), "seq", "A", "B", "LINK_HWYNET_STATUS")


def line_features(lines: DataFrame, nodes: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Transit lines as polylines (points and WKT) with their attributes."""
    located = spatial.attach_coordinates(nodes.select("line_name", "seq", F.abs(F.col("node").cast("bigint")).alias("node")),
                                         coordinates, "node")
    shapes = spatial.points_to_lines(located, ["line_name"], "seq")
    return lines.join(shapes, "line_name").withColumn("wkt", G.line_wkt("points"))
