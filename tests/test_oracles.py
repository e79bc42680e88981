"""Every query with SQL gives the rows that DuckDB gives; the others give some."""

import os

import duckdb
import pytest

from vecforge import registry

SQL = registry.oracle_sql()


def connect(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf}/{name}'")
    return c


def plain(v):
    return tuple(plain(x) for x in v) if hasattr(v, "__len__") and not isinstance(v, str) else None if v != v else v


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = connect(sf).sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["m1_insert", "m5_replace_deleted"])
def test_ids_beyond_100000(spark, tmp_path, name):
    """Fresh ids, which start at 100,000, are there already in larger tables."""
    spark.range(100_101).selectExpr("id vec_id", "array(cast(id % 97 as float)) embedding", "cast(id % 10 as int) label").coalesce(1).write.parquet(f"{tmp_path}/made")
    os.rename(next((tmp_path / "made").glob("part-*.parquet")), tmp_path / "embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    assert rows(registry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_some_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
