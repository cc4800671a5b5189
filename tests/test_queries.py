"""Every registered query against DuckDB on the smallest shared tables."""

import os

import pytest
from compare import differences, duck

from spanveil.plans.queries import ORACLES, QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="shared tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(ROOT)


def test_every_oracle_has_its_query():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, ROOT)
    assert differences(result, con, ORACLES[name]) is None


def test_occurrence_fakes_keep_the_shape(spark):
    by_place = dict(QUERIES["occurrence_fakes"](spark, ROOT).collect())
    plain = dict(QUERIES["scrub_fake"](spark, ROOT).collect())
    assert by_place.keys() == plain.keys()
    assert any(by_place[k] != plain[k] for k in plain)
