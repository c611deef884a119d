"""Every query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from almanac.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """One form of a value: pandas turns whole numbers beside nulls into floats, and nulls into NA or NaN."""
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 6)
    return v


def rows(df, columns):
    return sorted((tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns[:2] == ["student", "course"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_topk_plan_limits_before_the_shuffle(spark, sf_dir):
    plan = registry.QUERIES["ranked_with_count"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = registry.QUERIES["tristate_filter"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in plan  # texts are not read
