"""Lookups as joins.

The lookup side has one row for each position; ``order`` gives that order, since tables have
none.  Text keys compare without case, empty equals empty, and kinds never cross.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.criteria import wildcard
from tessella.plans.scratch import few, written


def _key(df: DataFrame, name: str) -> Column:
    return F.lower(df[name]) if dict(df.dtypes)[name] == "string" else df[name]


def xlookup(df: DataFrame, key: str, table: DataFrame, table_key: str, returns: list[str], order: list[str], search: int = 1, if_not_found=None) -> DataFrame:
    """Exact match: ``df`` with ``returns`` of the first row of ``table`` with its key, the last for ``search`` -1.

    A left join on a table made unique by key; Spark chooses the join by size.
    """
    pick = F.min_by if search > 0 else F.max_by
    unique = table.groupBy(_key(table, table_key).alias("_key")).agg(pick(F.struct(*returns, F.lit(True).alias("_found")), F.struct(*order)).alias("_row"))
    left = df.withColumn("_left", _key(df, key))
    out = left.join(unique, left["_left"].eqNullSafe(unique["_key"]), "left")
    miss = F.col("_row").isNull()
    return out.select(*(df[c] for c in df.columns), *(F.when(miss, F.lit(if_not_found)).otherwise(F.col(f"_row.{r}")).alias(r) if if_not_found is not None else F.col(f"_row.{r}").alias(r) for r in returns))


def xmatch(df: DataFrame, key: str, table: DataFrame, table_key: str, position: str, search: int = 1) -> DataFrame:
    """``df`` with the ``position`` column of the matching row, null for ``#N/A``."""
    return xlookup(df, key, table, table_key, [position], [position], search)


def nearest(df: DataFrame, key: str, table: DataFrame, table_key: str, returns: list[str], larger: bool = False, by: list[str] | None = None) -> DataFrame:
    """Approximate match: the row of ``table`` with the largest key not above (``larger``: the smallest not below), within ``by``.

    Both sides go into one sorted pass for each group of ``by``, an as-of join without a range
    condition.  Without ``by`` the pass is dealt into ranges of the key, and what reaches over
    a range's edge comes from a table with a row for each range; few rows pass through one task.
    """
    by = by or []
    side = lambda d, k, mark, cols: d.select(*by, F.col(k).alias("_k"), F.lit(mark).alias("_side"), *cols)
    # At a tie the table's row comes first, in the direction of the search.
    payload = F.struct(*(F.col(r) for r in returns)).alias("_row")
    rows = df.withColumn("_df", F.struct(*df.columns))
    kind = table.select(payload).schema[0].dataType
    both = side(rows, key, 0 if larger else 1, [F.col("_df"), F.lit(None).cast(kind).alias("_row")]).unionByName(side(table, table_key, 1 if larger else 0, [F.lit(None).cast(rows.schema["_df"].dataType).alias("_df"), payload]))
    both = both.where(F.col("_k").isNotNull() | F.col("_df").isNotNull())
    if by:
        found = both.withColumn("_hit", _fill(Window.partitionBy(*by), larger))
    elif few(df.select(key)) and few(table.select(table_key)):
        found = both.withColumn("_hit", _fill(Window.partitionBy(), larger))
    else:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = written(both.repartitionByRange(n, "_k", "_side").withColumn("_part", F.spark_partition_id()), "nearest")
        edge = ranged.where("_row is not null").groupBy("_part").agg((F.min_by if larger else F.max_by)("_row", "_k").alias("_edge"))
        parts = df.sparkSession.range(n).select(F.col("id").cast("int").alias("_part"))
        over = Window.orderBy(F.col("_part").desc() if larger else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
        edges = parts.join(edge, "_part", "left").select("_part", F.last("_edge", ignorenulls=True).over(over).alias("_edge"))
        found = ranged.join(F.broadcast(edges), "_part").withColumn("_hit", F.coalesce(_fill(Window.partitionBy("_part"), larger), "_edge"))
    found = found.where(F.col("_df").isNotNull())
    return found.select("_df.*", *(F.when(F.col("_k").isNotNull(), F.col(f"_hit.{r}")).alias(r) for r in returns))


def _fill(w, larger: bool) -> Column:
    """The table's row last seen, going up the key or, for ``larger``, down: a frame that only grows is one pass."""
    order = [F.desc("_k"), F.desc("_side")] if larger else ["_k", "_side"]
    return F.last("_row", ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def wildcard_lookup(table: DataFrame, table_key: str, pattern: str, returns: list[str], order: list[str]) -> DataFrame:
    """One row: ``returns`` of the first row whose text key matches a pattern."""
    return table.where(F.col(table_key).rlike(wildcard(pattern))).agg(F.min_by(F.struct(*returns), F.struct(*order)).alias("_row")).select("_row.*")


def within(df: DataFrame, key: str, other: DataFrame, other_key: str, present: bool = True) -> DataFrame:
    """FILTER by COUNTIF: rows whose key is (not) among another table's keys."""
    keys = other.select(_key(other, other_key).alias("_other")).distinct()
    return df.join(keys, _key(df, key).eqNullSafe(keys["_other"]), "left_semi" if present else "left_anti")


def index(table: DataFrame, order: list[str], row: int, column: str) -> DataFrame:
    """INDEX: one cell by position, from a top-k of the order."""
    return table.orderBy(*order).offset(row - 1).limit(1).select(column)
