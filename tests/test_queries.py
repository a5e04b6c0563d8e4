"""Every registered query of the engine against its SQL on the driver's smallest tables."""

import glob
import importlib
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from courier import registry


@pytest.fixture(scope="module")
def sql(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_its_sql(spark, sf, sql, name):
    want = sql.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    df = registry.queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows or name in ("session_expired",)
    assert sorted(map(str, map(tuple, df.select(*[F.col(f"`{c}`") for c in columns]).collect()))) == sorted(map(str, rows))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_training_data_operators(monkeypatch):
    """As after taking out the folder and the pipeline."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "courier.llm") or name.startswith("courier.llm."):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for name in [n for n in sys.modules if n == "__spark_entry__" or n == "corpus_pipeline" or n.startswith("courier.llm")]:
        monkeypatch.delitem(sys.modules, name)
    package = importlib.import_module("courier")
    monkeypatch.delattr(package, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_skewed_keys_stay_parallel(spark):
    """A key with all rows is numbered in many tasks: no window is partitioned by the key alone over the rows."""
    from courier.operators.ranking import positions

    plan = positions(spark.range(1000).withColumn("k", F.lit(1)), ["k"], "id", width=10)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 2 and sum("__range" in w.split("windowspecdefinition")[1] for w in windows) >= 1
