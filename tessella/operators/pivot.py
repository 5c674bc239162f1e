"""Pivot tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that a sheet has; a field of more items makes no pivot table.
MOST_ITEMS = 16_384

_AGGREGATES = {"sum": F.sum, "count": F.count, "average": F.avg, "min": F.min, "max": F.max}


def pivot(df: DataFrame, rows: list[str], column: str | None, value: str, how: str = "sum", items: list | None = None, page: Column | None = None, totals: bool = True, percent_of_row: bool = False) -> DataFrame:
    """A row for each combination of ``rows``, a column for each item, and ``total``.

    ``page`` filters first.  With ``totals`` a last row, with null row fields, has the grand
    totals.  Items are found by one distinct of the column field unless they are given, in
    order, empty cells last as ``(blank)``; more than ``MOST_ITEMS`` raise ValueError.
    """
    f = _AGGREGATES[how]
    some = df.where(page) if page is not None else df
    if column is None:
        grouped = some.rollup(*rows) if totals else some.groupBy(*rows)
        if not totals:
            return grouped.agg(f(value).alias("total"))
        level = F.grouping_id()
        return grouped.agg(f(value).alias("total"), level.alias("_g")).where((F.col("_g") == 0) | (F.col("_g") == 2 ** len(rows) - 1)).drop("_g")
    if items is None:
        found = [r[0] for r in some.select(column).distinct().limit(MOST_ITEMS + 1).collect()]
        if len(found) > MOST_ITEMS:
            raise ValueError(f"more than {MOST_ITEMS} items of {column}")
        items = sorted(i for i in found if i is not None) + [None] * (None in found)
    shown = {i: "(blank)" if i is None else str(i) for i in items}
    cells = [f(F.when(F.col(column).eqNullSafe(F.lit(i)), F.col(value))).alias(shown[i]) for i in items]
    grouped = (some.rollup(*rows) if totals else some.groupBy(*rows)).agg(*cells, f(value).alias("total"), *([F.grouping_id().alias("_g")] if totals else []))
    if totals:
        grouped = grouped.where((F.col("_g") == 0) | (F.col("_g") == 2 ** len(rows) - 1)).drop("_g")
    if percent_of_row:
        grouped = grouped.select(*rows, *(F.try_divide(F.col(f"`{shown[i]}`"), F.col("total")).alias(shown[i]) for i in items), F.lit(1.0).alias("total"))
    return grouped


def calculated_field(pivoted: DataFrame, name: str, formula: Column) -> DataFrame:
    """A field computed from the sums of others."""
    return pivoted.withColumn(name, formula)


def getpivotdata(pivoted: DataFrame, field: str, **items) -> DataFrame:
    """One value of a pivot table; no row is ``#REF!``."""
    return pivoted.where(reduce(lambda a, b: a & b, (F.col(k) == v for k, v in items.items()), F.lit(True))).select(field)


def show_as_percent(df: DataFrame, value: str, by: list[str], name: str = "share") -> DataFrame:
    """Each value as a share of its group's sum."""
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(*by))))
