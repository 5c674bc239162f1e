"""Edits of tables: each returns a new DataFrame, so a batch is applied by using its last one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_cells(df: DataFrame, keys: list[str], edits: DataFrame) -> DataFrame:
    """Upsert: rows of ``edits`` replace those of the same keys, and new ones are added."""
    kept = df.join(edits.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(edits, allowMissingColumns=True)


def clear_range(df: DataFrame, rows: Column, columns: list[str]) -> DataFrame:
    return df.select(*(F.when(~F.coalesce(rows, F.lit(False)), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def insert_rows(df: DataFrame, row: str, at: int, count: int = 1) -> DataFrame:
    """Make room in a row number column."""
    return df.withColumn(row, F.when(F.col(row) >= at, F.col(row) + count).otherwise(F.col(row)))


def delete_rows(df: DataFrame, row: str, at: int, count: int = 1) -> DataFrame:
    return df.where(~F.col(row).between(at, at + count - 1)).withColumn(row, F.when(F.col(row) >= at + count, F.col(row) - count).otherwise(F.col(row)))


def insert_columns(df: DataFrame, at: int, names: list[str], kind: str = "string") -> DataFrame:
    c = df.columns
    return df.select(*c[: at - 1], *(F.lit(None).cast(kind).alias(n) for n in names), *c[at - 1 :])


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Width-checked append by name."""
    if set(rows.columns) != set(df.columns):
        raise ValueError(f"columns {rows.columns} are not {df.columns}")
    return df.unionByName(rows)


def copy_range(df: DataFrame, row: str, low: int, high: int, to: int, move: bool = False) -> DataFrame:
    """Rows by number laid over others; a move leaves nothing behind."""
    source = df.where(F.col(row).between(low, high)).withColumn(row, F.col(row) - low + to)
    rest = df.where(~F.col(row).between(to, to + high - low))
    if move:
        rest = rest.where(~F.col(row).between(low, high))
    return rest.unionByName(source)


def hide_rows(df: DataFrame, rows: Column, name: str = "row_hidden") -> DataFrame:
    return df.withColumn(name, F.coalesce(rows, F.lit(False)))


def totals_row(df: DataFrame, **functions: Column) -> DataFrame:
    """One row of aggregates."""
    return df.agg(*(f.alias(n) for n, f in functions.items()))


def calculated_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """LET and calculated columns: later ones may use earlier ones."""
    return reduce(lambda d, c: d.withColumn(*c), columns.items(), df)


def slicer(df: DataFrame, x: str, selected: list) -> DataFrame:
    return df.where(F.col(x).isin(selected))


def timeline(df: DataFrame, x: str, start: str, end: str) -> DataFrame:
    """Both days included."""
    return df.where((F.to_date(x) >= F.to_date(F.lit(start))) & (F.to_date(x) <= F.to_date(F.lit(end))))


def merge_template(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """``{{key}}`` in text columns replaced."""
    types = dict(df.dtypes)
    fill = lambda c: reduce(lambda x, kv: F.replace(x, F.lit("{{" + kv[0] + "}}"), F.lit(kv[1])), values.items(), F.col(c))
    return df.select(*(fill(c).alias(c) if types[c] == "string" else F.col(c) for c in df.columns))


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A window of rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def create_table(columns: dict[str, str], spark) -> DataFrame:
    """An empty table of names and types."""
    return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in columns.items()))


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def delete_columns(df: DataFrame, at: int, count: int = 1) -> DataFrame:
    """Without ``count`` columns from a place on, from 1."""
    return df.select(*df.columns[: at - 1], *df.columns[at - 1 + count :])


def resize(df: DataFrame, row: str, high: int, columns: list[str]) -> DataFrame:
    """A table cut, or widened by empty columns, to rows up to ``high`` and these columns."""
    return df.where(F.col(row) <= high).select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def fill_formula(df: DataFrame, x: str, rows: Column, formula: Column) -> DataFrame:
    """A formula filled into some cells of a column; the others stay."""
    return df.withColumn(x, F.when(F.coalesce(rows, F.lit(False)), formula).otherwise(F.col(x)) if x in df.columns else F.when(F.coalesce(rows, F.lit(False)), formula))


def define_name(df: DataFrame, name: str) -> DataFrame:
    """A name for a table or range, for SQL of the session."""
    df.createOrReplaceTempView(name)
    return df


def merge_cells(df: DataFrame, row: str, low: int, high: int, columns: list[str]) -> DataFrame:
    """Merged cells keep the value of the first row and column alone."""
    inside = F.col(row).between(low, high)
    return df.select(*(F.when(inside & ~((F.col(row) == low) & F.lit(c == columns[0])), None).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def remove_duplicates(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each combination of some columns."""
    rest = [c for c in df.columns if c not in columns]
    first = df.groupBy(*columns).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*(F.col(c) if c in columns else F.col(f"_row.{c}").alias(c) for c in df.columns))
