"""Every query of the catalogue against its SQL; those without SQL run and return rows."""

import oracle
import pytest

from sparkrank import queries

#: Fits of many rounds, whose parts tests/test_trees.py, test_rank_fm.py and test_whole.py hold against twins.
SLOW = {"gbt_oof", "categorical_gbt_oof", "cross_net_oof", "adversarial_auc"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connection(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, con, name):
    assert oracle.difference(queries.QUERIES[name](spark, sf), con, queries.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL) - SLOW))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    rows = queries.flagship(spark, sf).collect()
    assert len(rows) == 20 and all(0 < r["auc"] < 1 for r in rows) and sum(r["best"] for r in rows) == 5
