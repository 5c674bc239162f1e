"""Dynamic arrays: tables that spill.  Row order is that of the ``order`` columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessella.operators.ranking import with_position


def sort_keys(df: DataFrame, keys: list[str], descending: list[bool] | None = None) -> list[Column]:
    """Text without case; empty first when ascending, last when descending."""
    types = dict(df.dtypes)
    out = []
    for k, down in zip(keys, descending or [False] * len(keys), strict=True):
        c = F.lower(k) if types[k] == "string" else F.col(k)
        out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return out


def sort(df: DataFrame, keys: list[str], descending: list[bool] | None = None, order: list[str] | None = None) -> DataFrame:
    """SORT and SORTBY: stable by ``order``."""
    return df.orderBy(*sort_keys(df, keys, descending), *(order or []))


def filter_(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(F.coalesce(mask, F.lit(False)))


def unique(df: DataFrame, columns: list[str], order: list[str], exactly_once: bool = False) -> DataFrame:
    """UNIQUE: distinct rows of some columns, case counting, in order of first occurrence in ``_first``."""
    out = df.groupBy(*columns).agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return (out.where("_n = 1") if exactly_once else out).drop("_n")


def take(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first rows, or the last for a negative n, by a distributed top-k."""
    if n > 0:
        return df.orderBy(*order).limit(n)
    return df.orderBy(*(F.desc(o) for o in order)).limit(-n)


def drop(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """All but the first rows, or but the last."""
    placed = with_position(df, order if n > 0 else [F.desc(o) for o in order])
    return placed.where(F.col("position") > abs(n)).drop("position")


def choose_rows(df: DataFrame, rows: list[int], order: list[str]) -> DataFrame:
    """Rows by place, repeats allowed, negative from the end; ``at`` has the place in the result."""
    n = df.count() if any(r < 0 for r in rows) else 0
    wanted = df.sparkSession.createDataFrame([(i, r if r > 0 else n + 1 + r) for i, r in enumerate(rows, 1)], "at int, position long")
    return with_position(df, order).join(F.broadcast(wanted), "position").drop("position")


def vstack(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def hstack(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Side by side by place; what one side lacks is null."""
    return with_position(left, left_order).join(with_position(right, right_order), "position", "full")


def tocol(df: DataFrame, columns: list[str], order: list[str], ignore_empty: bool = False) -> DataFrame:
    """(order..., column, value): cells of a range below each other, row by row."""
    parts = F.array(*(F.struct(F.lit(i).alias("column"), F.col(c).alias("value")) for i, c in enumerate(columns, 1)))
    out = df.select(*order, F.explode(parts).alias("x")).select(*order, "x.*")
    return out.where("value is not null") if ignore_empty else out


def wraprows(df: DataFrame, x: str, width: int, order: list[str]) -> DataFrame:
    """(row, c1, ... cN): a column as rows of a width."""
    placed = with_position(df.select(x, *[o for o in order if o != x]), order)
    at = F.col("position") - 1
    return placed.groupBy((F.floor(at / width) + 1).alias("row")).agg(*(F.max(F.when(at % width == i, F.col(x))).alias(f"c{i + 1}") for i in range(width)))


def transpose(df: DataFrame, key: str, columns: list[str], keys: list) -> DataFrame:
    """A row for each of ``columns`` and a column for each of ``keys``; empty cells are 0."""
    long = df.select(F.col(key).alias("_k"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x"))
    return long.groupBy("x.name").pivot("_k", keys).agg(F.first("x.value")).fillna(0.0)


def sequence(spark, rows: int, columns: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    r = spark.range(rows)
    return r.select((F.col("id") + 1).alias("row"), *((F.lit(float(start)) + (F.col("id") * columns + c) * float(step)).alias(f"c{c + 1}") for c in range(columns)))


def mmult(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of matrices in long form: (i, k, value) and (k, j, value) to (i, j, value)."""
    x, y = a.select("i", "k", F.col("value").alias("x")), b.select("k", "j", F.col("value").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def scan(df: DataFrame, by: list[str], order: list[str], x: str, start: float, step, name: str = "scan") -> DataFrame:
    """SCAN within each group of ``by``, by a Python lambda over columns (state, value); groups must fit a task."""
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(x).alias("_x")))).alias("_rows"))
    states = F.aggregate("_rows", F.array(F.lit(float(start))), lambda s, r: F.concat(s, F.array(step(F.element_at(s, -1), r["_x"]))))
    out = rows.select(*by, F.posexplode("_rows").alias("p", "r"), F.slice(states, 2, F.size("_rows")).alias("_s"))
    return out.select(*by, *(F.col(f"r.{o}").alias(o) for o in order), F.get("_s", F.col("p")).alias(name))


def lag(x: str, order: list[str], by: list[str] | None = None, n: int = 1) -> Column:
    """A relative reference to an earlier row."""
    return F.lag(x, n).over(Window.partitionBy(*(by or [])).orderBy(*order))


def moving(x: str, order: list[str], size: int, by: list[str]) -> Column:
    """AVERAGE over a frame of ``size`` rows that ends at the row."""
    return F.avg(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(size - 1), 0))


def choose_columns(df: DataFrame, columns: list[int]) -> DataFrame:
    """CHOOSECOLS: columns by place, from 1 or negative from the end; one that comes again gets a number behind its name."""
    names, seen = [df.columns[c - 1 if c > 0 else c] for c in columns], []
    for n in names:
        seen.append(f"{n}_{names[: len(seen)].count(n) + 1}" if n in names[: len(seen)] else n)
    return df.select(*(F.col(f"`{n}`").alias(s) for n, s in zip(names, seen, strict=True)))


def expand(df: DataFrame, rows: int, columns: list[str], order: list[str], pad=None) -> DataFrame:
    """EXPAND: ``df`` with so many rows and with columns of these names, padded (by null where the pad is not of a column's type); ``position`` is a row's place."""
    wide = df
    for c in columns:
        if c not in df.columns:
            wide = wide.withColumn(c, F.lit(pad))
    placed = with_position(wide, order)
    more = df.sparkSession.range(1, rows + 1).select(F.col("id").alias("position"))
    filled = more.join(placed.withColumn("_there", F.lit(True)), "position", "left")
    kinds = dict(placed.dtypes)
    return filled.select("position", *(F.when(F.col("_there"), F.col(c)).otherwise(F.lit(pad).try_cast(kinds[c])).alias(c) for c in placed.columns if c != "position"))


def torow(df: DataFrame, columns: list[str], order: list[str], ignore_empty: bool = False) -> DataFrame:
    """TOROW: (column, value) with places of a single row, read row by row; a row of any length is kept long."""
    long = tocol(df, columns, order, ignore_empty)
    return with_position(long, [*order, "column"], "at").select(F.col("at").alias("column"), "value")


def wrapcols(df: DataFrame, x: str, height: int, order: list[str]) -> DataFrame:
    """WRAPCOLS: (row, column, value) of a column cut into columns of a height."""
    placed = with_position(df.select(x, *[o for o in order if o != x]), order)
    at = F.col("position") - 1
    return placed.select((at % height + 1).alias("row"), (F.floor(at / height) + 1).alias("column"), F.col(x).alias("value"))


def bycol(df: DataFrame, columns: list[str], f) -> DataFrame:
    """BYCOL: one row with ``f``, a function of a column that gives an aggregate, of each column; one scan."""
    return df.agg(*(f(F.col(c)).alias(c) for c in columns))


def makearray(spark, rows: int, columns: int, f) -> DataFrame:
    """MAKEARRAY: a cell for each row and column number, by a function of these two columns."""
    return spark.range(1, rows + 1).select(F.col("id").alias("row"), *(f(F.col("id"), F.lit(c)).alias(f"c{c}") for c in range(1, columns + 1)))


def randarray(spark, rows: int, columns: int = 1, low: float = 0.0, high: float = 1.0, whole: bool = False, seed: int = 42) -> DataFrame:
    """RANDARRAY: random numbers from ``low`` to ``high``, whole ones with both ends included."""
    draw = lambda c: F.floor(F.rand(seed + c) * (high - low + 1)).cast("double") + low if whole else F.rand(seed + c) * (high - low) + low
    return spark.range(1, rows + 1).select(F.col("id").alias("row"), *(draw(c).alias(f"c{c}") for c in range(1, columns + 1)))


def munit(spark, n: int) -> DataFrame:
    """MUNIT in long form: (i, j, value)."""
    return spark.range(1, n + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(n)).cast("array<long>")).alias("j")).withColumn("value", (F.col("i") == F.col("j")).cast("double"))


def _square(matrix) -> np.ndarray | None:
    a = np.array([list(r) for r in matrix], float) if matrix is not None else np.zeros((0, 1))
    return a if a.ndim == 2 and a.shape[0] == a.shape[1] and len(a) else None


@F.pandas_udf(DoubleType())
def mdeterm(matrix: pd.Series) -> pd.Series:
    """MDETERM of a column of matrices (array<array<double>>), null for one that is not square."""
    return pd.Series([None if (a := _square(m)) is None else float(np.linalg.det(a)) for m in matrix], dtype="float64")


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def minverse(matrix: pd.Series) -> pd.Series:
    """MINVERSE of a column of matrices, null for one that is singular or not square."""

    def one(m):
        a = _square(m)
        return None if a is None or abs(np.linalg.det(a)) < 1e-12 else np.linalg.inv(a).tolist()

    return pd.Series([one(m) for m in matrix], dtype="object")
