"""Every registered query of this library against its SQL, and the driver's entry points."""

import os

import duckdb
import pytest

import __spark_entry__
from augurline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(cell(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert plain(df.collect(), columns) == plain(rows, columns)


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["series_id", "lead_time", "model", "model_ord", "n_origins", "mean_loss"] and found.count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_text_queries_are_optional():
    folder = os.path.join(os.path.dirname(__spark_entry__.__file__), "augurline", "llm")
    assert any(n.startswith("op1_") for n in __spark_entry__.queries()) == os.path.isdir(folder)


def test_plans_push_columns_down(spark, sf):
    plan = catalog.flagship(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan and "Python" not in plan and "Pandas" not in plan
