"""Registered queries over the test tables, with the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """SELECT l_returnflag, l_linestatus, round(coalesce(sum(l_extendedprice) FILTER (l_discount >= 0.05), 0), 2) AS sumifs
    FROM lineitem GROUP BY 1, 2"""
)
def sumifs_returnflag(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.coalesce(F.sum(F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice"))), F.lit(0.0)), 2).alias("sumifs"))
