"""Every registered query of the spreadsheet operators against DuckDB."""

import datetime
import math

import duckdb
import pytest

from tessella.operators import pivot
from tessella.plans import function_queries, queries, table_queries  # noqa: F401  these register queries
from tessella.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"double": "DOUBLE", "bigint": "BIGINT", "string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "tinyint": "TINYINT"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else "nan" if math.isnan(v) else float(f"{v:.11g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    expected = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    kinds = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == kinds
    rows = sorted((tuple(plain(dict(zip(expected.columns, r, strict=True))[c]) for c in columns) for r in expected.fetchall()), key=str)
    assert got == rows


def test_engineering_functions_of_ids_beyond_dec2bin(spark, duck, tmp_path):
    ids = [0, 499, 500, 511, 512, 1499]
    duck.sql(f"copy (select user_id event_id, user_id, 1.5::DOUBLE \"value\" from unnest({ids}::BIGINT[]) t(user_id)) to '{tmp_path}/events.parquet'")
    got = {r.event_id: r for r in registry.QUERIES["engineering_functions_all"](spark, str(tmp_path)).collect()}
    assert len(got) == len(ids)
    sql = registry.ORACLE_SQL["engineering_functions_all"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")
    found = duck.sql(sql)
    assert all(plain(got[r[0]][c]) == plain(v) for r in found.fetchall() for c, v in zip(found.columns, r, strict=True))
    assert sorted((r.dec2bin_error, r.dec2bin, r.dec2hex) for r in got.values() if r.dec2bin is None) == [("#NUM!", None, "200"), ("#NUM!", None, "5DB")]


def test_pivot_finds_its_items(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 4)], "k string, c string, v long")
    got = pivot.pivot(df, ["k"], "c", "v")
    assert got.columns == ["k", "x", "y", "(blank)", "total"]
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1, None, 2, 3), ("b", None, 4, None, 4), (None, 1, 4, 2, 7)]
