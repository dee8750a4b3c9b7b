"""Every registered query of the dialect against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tessera import queries
from tessera.plans.analyzer import Table
from tessera.operators.relational import select
from tessera.plans.grammar import parse

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.queries()))
def test_matches(spark, duck, name):
    got = queries.queries()[name](spark, DATA)
    want = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert mine == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["order_asc_nulls", "order_desc_nulls", "order_hidden", "order_by_agg"])
def test_whole_tables_are_sorted(spark, duck, name):
    got = [tuple(r) for r in queries.queries()[name](spark, DATA).collect()]
    assert got == duck.execute(queries.oracle_sql()[name]).fetchall()
    assert "nulls" not in name or {None} < {r[1] for r in got}  # the null boundary is crossed


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """In a copy of the repository without the two folders, queries, oracle and import are those of the dialect."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).parents[1]
    for name in ("tessera", "tests"):
        shutil.copytree(here / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if (here / name).exists():
            shutil.copy(here / name, tmp_path / name)
    told = "import __spark_entry__ as e, bench; print(len(e.queries()), len(e.oracle_sql()), sorted(set(e.queries()) ^ set(e.oracle_sql())))"
    out = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.split("\n")[0] == f"{len(queries.queries())} {len(queries.oracle_sql())} []"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(queries.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    t = {"orders": Table("orders", spark.read.parquet(f"{DATA}/orders.parquet"), "o_orderkey")}
    plan = select(parse("SELECT o_orderkey FROM orders WHERE o_orderkey >= 10 AND o_totalprice > 5.0"), t).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan  # the plan text is cut before the second filter
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    plan = select(parse("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 3"), t).df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
