"""Every registered query against its SQL in DuckDB, and the plans behind the large ones."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from opinaria.plans import registry

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
# The queries of the training-data operators have their own tests.
QUERIES = {name: driver.queries()[name] for name in registry.QUERIES}
SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in registry.QUERIES}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    result = duck.execute(SQL[name])
    columns = sorted(got.columns)
    described = {d[0]: str(d[1]) for d in result.description}
    assert {c: TYPES[t] for c, t in got.dtypes} == described
    order = [d[0] for d in result.description]
    expected = sorted(repr([dict(zip(order, row))[c] for c in columns]) for row in result.fetchall())
    rows = sorted(repr([row[c] for c in columns]) for row in got.collect())
    assert rows == expected
    assert rows
    plan = plan_of(got)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scoring_plan(spark):
    plan = plan_of(QUERIES["nb_bernoulli_scores"](spark, str(DATA)))
    assert "BroadcastHashJoin" in plan and "SinglePartition" not in plan and "Python" not in plan
    # One exchange of one row per text, one of the model's weights.
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_comments_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["top5_comments"](spark, str(DATA)))
    assert re.search(r"Exchange hashpartitioning[^\n]*\n\W*WindowGroupLimit[^\n]*Partial", plan)


def test_texts_are_cleaned_once(spark):
    plan = plan_of(QUERIES["scorer_map"](spark, str(DATA)))
    assert plan.count("https?://") == 1


def test_stop_words_are_a_hash_set(spark):
    assert "INSET" in plan_of(QUERIES["stop_words_rejoined"](spark, str(DATA)))


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(QUERIES["term_frequencies"](spark, str(DATA)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry(spark):
    assert driver.entry(spark).columns == ["model", "label", "n", "n_right"]


def test_import_needs_no_jvm_and_no_jars(tmp_path):
    code = (
        "import pathlib, pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'\n"
        "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))\n"
        "from pyspark import SparkContext; assert SparkContext._jvm is None"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
