"""Every query against its SQL twin on the smallest tables."""

import pytest
from conftest import SMALL

from quercus.plans.queries import ORACLES, QUERIES
from tools.check_queries import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    diff, _, _ = compare(spark, con, SMALL, name)
    assert diff is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_fixed_corpus_has_no_direct_straddle(spark):
    """After the fix, what is still flagged is inherited: no flagged edge sits on the class itself."""
    from pyspark.sql import functions as F

    from quercus.operators.lint import straddle_lint
    from quercus.operators.repair import direct_edges, straddle_edges
    from quercus.plans.queries import fixed
    from quercus.sources.upper import builtin_upper
    from quercus.workspace import Workspace

    left = straddle_lint(fixed(spark, SMALL)[0], builtin_upper(), Workspace(spark))
    assert straddle_edges(left, fixed(spark, SMALL)[0]).count() == 0
    assert direct_edges(fixed(spark, SMALL)[0]).where(F.col("cls") == "").count() == 0
