"""Every query with a twin agrees with DuckDB on the smallest tables."""

import pytest

from tests.parity import connect, differs
from tracemill.plans import PLANS, TWINS

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"join_foreign_keys", "txt_quotes", "join_split_leaks", "set_duplicate_keys", "join_first_match", "agg_coverage"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, con, name):
    why = differs(spark, con, SF, PLANS[name], TWINS[name])
    assert not why or why == "no rows" and name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(TWINS)))
def test_rows_only(spark, name):
    assert PLANS[name](spark, SF).count() > 0
