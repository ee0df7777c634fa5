"""Parcel data on zone geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame

from parcelflow import constants as K
from parcelflow.operators.aggregates import area_weighted, totals_by_part
from parcelflow.operators.spatial import overlay, sum_within


def aggregate_to_zones(parcels: DataFrame, data: DataFrame, zones: DataFrame, fields: dict[str, tuple[str, str]],
                       cell: float, pieces: DataFrame | None = None) -> DataFrame:
    """Area-weighted parcel values per zone. A stored overlay (``pieces``) is used instead of a new one if given.

    In a new one, pieces take their parcel's values along: parcels are fewer than pieces, which so are added up where they are found.
    """
    if pieces is not None:
        return area_weighted(pieces, data, zones, "parcelid", "zone_id", fields)
    totals = totals_by_part(data, "parcelid", [*fields])
    names = {c: f"__value_{i}" for i, c in enumerate(totals.columns[1:])}
    valued = parcels.select("parcelid", "part_ring").join(totals.withColumnsRenamed(names), "parcelid", "left")
    pieces = overlay(valued, zones, cell, carry=[*names.values()])
    return area_weighted(pieces, None, zones, "parcelid", "zone_id", {names[c]: how for c, how in fields.items()}, n_rows=names["n_rows"])


def buffered_zone_sums(parcels: DataFrame, zones: DataFrame, values: list[str], distance: float = K.ZONE_BUFFER_FT,
                       cell: float | None = None) -> DataFrame:
    """Sum of parcel values whose centre lies within a distance of each zone."""
    return sum_within(parcels, zones, distance, values, cell=cell)
