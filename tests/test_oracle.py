"""Every registered query with an oracle, compared on the smallest data folder."""

import os

import pytest

from catalog import ORACLE, QUERIES
from catalog.views import WITH_LABELLED
from tools.check_oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return duck(FOLDER)


#: These report ranking metrics of the labelled test part, which need a positive; the smallest folder has none there.
EXPERIMENTS = {name for name in ORACLE if name.startswith("experiment_")}


@pytest.mark.parametrize("name", sorted(EXPERIMENTS))
def test_metrics_without_positives_raise(spark, con, name):
    """The rows of these queries are compared at sf0.01 by tools/check_oracle.py."""
    assert con.execute(f"{WITH_LABELLED} SELECT coalesce(sum(label), 0) FROM split WHERE split = 'test'").fetchall() == [(0,)]
    with pytest.raises(Exception, match="needs positives"):
        QUERIES[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", sorted(set(ORACLE) - EXPERIMENTS))
def test_matches_oracle(spark, con, name):
    status, note = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE[name])
    assert status == "ok", note


def test_registry_is_consistent():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) >= 70
