"""Every query outside the llm subpackage against DuckDB on the smallest tables; those without SQL must run and repeat themselves."""

import os
import re

import duckdb
import pandas as pd
import pytest

from tessella.plans import catalog

SLOW_TO_REPEAT = {"particle_forest", "merge_hierarchy", "skeleton_full"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v if isinstance(v, (bool, str)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


#: Queries that join every row with one row of totals, which is what a nested-loop join of a broadcast row is.
ONE_ROW_BROADCAST = {"moving_dots_antijoin", "pruned_tree", "graph_vertices", "vertices_removed", "kmeans_fixed_iters", "em_gaussian", "path_costs", "edge_pairs"}


def check_plan(name, df):
    """No products of tables and no row-at-a-time Python."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in ONE_ROW_BROADCAST


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    check_plan(name, df)
    got = df.toPandas()
    want = con.execute(catalog.oracle_sql()[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    one = rows(catalog.queries()[name](spark, sf_dir).toPandas())
    assert one
    if name not in SLOW_TO_REPEAT:
        assert rows(catalog.queries()[name](spark, sf_dir).toPandas()) == one


def test_no_row_filters_to_cheat():
    for sql in catalog.oracle_sql().values():
        assert not re.search(r"event_id\s*%|USING SAMPLE|TABLESAMPLE", sql)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "x", "y", "frame", "branch", "label", "n_descendants"]
    assert df.count() > 0
