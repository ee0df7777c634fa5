"""Attach road segment attributes to model links by direction, class, distance and angle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow import constants as K
from parcelflow.functions import geometry as G
from parcelflow.functions import scalars as S
from parcelflow.operators.aggregates import match_rate
from parcelflow.operators.spatial import Search, nearest_line


def _road_class(col, freeways, arterials) -> Column:
    return F.when(F.col(col).isin(freeways), "fwy").when(F.col(col).isin(arterials), "art")


def _radius(radii: dict[str, float]) -> Column:
    return F.when(F.col("cls") == "fwy", F.lit(float(radii["fwy"]))).otherwise(F.lit(float(radii["art"])))


def conflate(links: DataFrame, segments: DataFrame, link_class: str = "capc", seg_class: str = "fwytag",
             radii=K.MATCH_RADIUS_FT, wide_radii=K.WIDE_MATCH_RADIUS_FT, dense: int = 256) -> DataFrame:
    """Every link with the segment it lies on, how far away that is, and which search found it.

    ``links``: link_id, points and a class; ``segments``: seg_id, points, miles, a class and optionally a
    signed ``direction``. First the nearest segment of equal direction and class; then, for links left over,
    the nearest of similar angle, with normal and with wide radii. ``tied`` marks equal candidates of equal
    length that a person must decide.
    """
    l = links.withColumn("cls", _road_class(link_class, K.LINK_FREEWAY_CLASSES, K.LINK_ARTERIAL_CLASSES))
    l = l.withColumns({"angle": G.line_angle("points"), "__c": G.line_centroid("points")})
    l = l.withColumns({"dir": S.cardinal_direction("angle"), "x": F.col("__c.x"), "y": F.col("__c.y")}).drop("__c")
    s = segments.withColumn("cls", _road_class(seg_class, K.SEGMENT_FREEWAY_CLASSES, K.SEGMENT_ARTERIAL_CLASSES))
    s = s.where(F.col("cls").isNotNull()).withColumn("angle", G.line_angle("points"))
    signed = F.col("direction") if "direction" in segments.columns else S.cardinal_direction("angle")
    s = s.withColumn("dir", signed)
    taggable = l.where(F.col("cls").isNotNull()).select("link_id", "cls", "dir", "x", "y", "angle")
    shapes = s.select("seg_id", "cls", "dir", "miles", "points", "angle")
    found = nearest_line(taggable, shapes, ["cls"], [
        Search(_radius(radii), same=("dir",)),
        Search(_radius(radii), angle_tolerance=K.ANGLE_TOLERANCE_DEG),
        Search(_radius(wide_radii), angle_tolerance=K.ANGLE_TOLERANCE_DEG)], dense=dense)
    used = F.when(F.col("search") == 3, _radius(wide_radii)).otherwise(_radius(radii))
    out = l.drop("x", "y").join(found, "link_id", "left")
    out = out.withColumn("search_dist_ft", F.when(F.col("cls").isNotNull(), used))
    attrs = s.drop("points", "angle", "dir", "cls", seg_class)
    return out.join(attrs.select("seg_id", *[F.col(c).alias(f"seg_{c}") for c in attrs.columns if c != "seg_id"]), "seg_id", "left")


def conflation_summary(conflated: DataFrame, link_class: str = "capc") -> DataFrame:
    return match_rate(conflated, link_class, "seg_id", K.LINK_FREEWAY_CLASSES + K.LINK_ARTERIAL_CLASSES)
