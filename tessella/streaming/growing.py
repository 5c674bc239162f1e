"""Aggregates of a growing table: rows appended to a source, read as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def appended(source: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """SUMIFS and its kin kept current as rows are appended, by Spark's stateful aggregation."""
    return source.groupBy(*keys).agg(*(v.alias(n) for n, v in aggregates.items()))


def windowed(source: DataFrame, time: str, width: str, late: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """The same in windows of event time; rows later than ``late`` are dropped, and so is their state."""
    out = source.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*(v.alias(n) for n, v in aggregates.items()))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)
