"""Registered queries against their SQL on the smallest tables. PARCELFLOW_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from checks import compare, registry

SF = "/root/testdata/sf0.001"
SHORT = ["theme_household", "theme_person", "theme_telework", "theme_external_travel", "mix_density", "qa_reconcile", "topline_summary",
         "free_flow_speeds", "percentiles_hot_groups", "attribute_change_years", "check_transit_links", "line_tables_round_trip",
         "overlay", "buffered_zone_sums", "compare_runs", "malformed_report", "overlay_polygons", "buffered_zone_polygons", "previous_by_microsecond",
         "carry_by_text", "cumulative_stddev_far_from_zero", "contained_large_sets", "ordered_sink", "publish_guarded", "read_gtfs_rejects", "dbf_two_passes",
         "load_raw_kinds"]


def test_every_query_has_a_check():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES) if os.environ.get("PARCELFLOW_ALL") else SHORT)
def test_query(spark, name):
    out, _, _ = compare.compare(spark, compare.connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert out.startswith("ok") and "TYPES" not in out, out
