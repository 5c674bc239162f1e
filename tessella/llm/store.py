"""Tables and scratch data that operators share between executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests), one beside the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """Hash of a row's id and text; a null has a value of its own, so neither stands for the other."""
    return F.xxhash64(id_col, F.col(id_col).isNull(), text_col, F.col(text_col).isNull())


#: Rows of a few narrow columns that may be broadcast: some tens of MB.
FEW = 1 << 20


def sized(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; beyond that Spark joins it by shuffling.

    For narrow tables that cost little to make, or are written already.
    """
    return F.broadcast(df) if df.count() <= rows else df


def input_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, to size buckets by; one pass that reads that column alone."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
