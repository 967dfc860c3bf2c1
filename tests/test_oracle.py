"""Registered queries against their SQL on the smallest tables.

The whole list takes minutes: run `python tests/oracle.py FOLDER` for all of it.
"""

from __future__ import annotations

import os

import pytest
from oracle import connect, difference

from marginloom import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["synth_persons", "enrich_citizenship", "margin_validation", "stable_ids",
         "rank_within_group", "select_n_per_cell", "match_by_rank", "hierarchy_margins",
         "equation_check", "reaggregate_exact", "crosswalk_rows", "interval_overlap",
         "release_diff", "latest_release", "keyset_page_asc", "keyset_page_desc_nulls_last",
         "boundary_dissolve_edges", "reproject_vertices", "delimited_scan", "slice_observations"]


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("driver tables are not present")
    registry.load()
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    assert difference(registry.QUERIES[name](spark, FOLDER), tables, registry.ORACLE[name]) is None


def test_every_query_has_sql_or_is_listed():
    registry.load()
    without = set(registry.QUERIES) - set(registry.ORACLE)
    assert without == {"text_manifest", "file_digests"}
