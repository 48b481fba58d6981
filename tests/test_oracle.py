"""Registered queries against their SQL at the smallest scale.

A part of them runs by default; ALL_QUERIES=1 runs every one.
"""

import os

import pytest
from oracle import compare, connect

from tidemark.checks import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
DEFAULT = [
    "gap_sessions", "geo_clusters", "exact_copies", "near_vectors", "burst_pairs", "nearest_class", "zero_shot_tags", "event_occasions",
    "chapters_asof", "snapshot_cdc", "edit_overlay", "library_stats", "browse_page", "event_list", "filename_dates", "quality_scores",
]
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else DEFAULT


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ok, note, _, _ = compare(spark, duck, QUERIES[name], ORACLES[name], SF)
    assert ok, note
