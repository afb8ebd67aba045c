"""Every registered query runs and, where there is an oracle, agrees with it; plan shapes."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from labelquality.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, small, name):
    """Values agree with the oracle; no cross join, and Python only where a model is plugged in."""
    plans = []

    def build(session, sf_dir):
        df = QUERIES[name](session, sf_dir)
        plans.append(_plan(df))
        return df

    text, _, good = check.compare(spark, con, name, build, ORACLES.get(name), small)
    assert good, text
    assert "CartesianProduct" not in plans[0] and "BroadcastNestedLoopJoin" not in plans[0]
    assert name == "annotate_with" or ("Python" not in plans[0] and "MapInPandas" not in plans[0])


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
    out = entry.entry(spark)
    assert out.count() == 1 and "cohen_kappa" in out.columns


def test_columns_are_pruned(spark, small):
    """Agreement needs neither the text nor anything else of the documents but the key."""
    plan = _plan(QUERIES["agreement_metrics"](spark, small))
    assert "ReadSchema: struct<doc_id:bigint>" in plan and "text:string" not in plan
    plan = _plan(QUERIES["ece_binary"](spark, small))
    assert "l_extendedprice" not in plan
