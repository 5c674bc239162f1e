"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


#: Rows of a few columns that one task may sort.
FEW = 1 << 20


def few(df: DataFrame, rows: int = FEW) -> bool:
    """Whether ``df`` has at most so many rows; no more than one beyond are counted."""
    return df.limit(rows + 1).count() <= rows


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
