"""Registered queries against their checking SQL; keys without SQL must give rows.

The iterative keys take longest and are compared with brute force in
test_operators.py and test_sites.py; TERRAFLOW_ALL=1 runs them here as well.
"""

import os

import compare
import pytest

import __spark_entry__ as entry

SF = f"{compare.TESTDATA}/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()
SLOW = {
    "depression_fill", "domain_cells", "downstream_trace", "fill_stats", "flood_corridor", "flow_accumulation", "mesh_components",
    "nearest_sample", "segment_checks", "site_validation", "site_warnings", "valley_span",
}
NAMES = sorted(n for n in QUERIES if os.environ.get("TERRAFLOW_ALL") or n not in SLOW)


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_keys_match():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare.differences(df, con, ORACLES[name]) == ""
    else:
        assert df.limit(1).count() == 1
