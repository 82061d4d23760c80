"""Every registered query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF_DIR}/{name}'")
    return con


def canonical(pdf):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        if hasattr(v, "year"):
            return f"{v.year:04d}-{v.month:02d}-{v.day:02d}"
        return repr(round(float(v), 9) + 0.0)

    ordered = pdf[sorted(pdf.columns)]
    return sorted(tuple(text(v) for v in row) for row in ordered.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    ours = contract.queries()[name](spark, SF_DIR).toPandas()
    theirs = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert canonical(ours) == canonical(theirs)


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "cohort_definition_id", "subject_id", "cohort_start_date", "cohort_end_date"
    ]
    assert df.count() == 1948 + 1598 + 1590 + 1316


@pytest.mark.parametrize(
    "name", ["feat_condition", "feat_test", "outcome_cohorts", "population", "nco_first", "feat_alltime"]
)
def test_same_result_without_broadcast(spark, duck, name):
    """The plan of large tables: sort-merge joins on salted and sliced keys."""
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for key in settings:
        spark.conf.set(key, "-1")
    try:
        df = contract.queries()[name](spark, SF_DIR).select("*")  # planned anew
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
        ours = canonical(df.toPandas())
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert ours == canonical(duck.execute(contract.oracle_sql()[name]).df())
