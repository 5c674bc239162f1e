"""Rules over rows: conditional formats, data validation, profiles, search and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operators of cellIs formats and of data validation.
OPERATORS = {
    "between": lambda c, a, b: c.between(a, b), "notBetween": lambda c, a, b: ~c.between(a, b), "equal": lambda c, a, b: c == a, "notEqual": lambda c, a, b: c != a,
    "greaterThan": lambda c, a, b: c > a, "lessThan": lambda c, a, b: c < a, "greaterThanOrEqual": lambda c, a, b: c >= a, "lessThanOrEqual": lambda c, a, b: c <= a,
}


def cell_is(x: str, operator: str, a, b=None) -> Column:
    return F.coalesce(OPERATORS[operator](F.col(x), F.lit(a), F.lit(b)), F.lit(False))


def text_rule(x: str, kind: str, part: str = "") -> Column:
    c, p = F.lower(F.col(x).cast("string")), part.lower()
    blank = F.col(x).isNull() | (F.trim(F.col(x).cast("string")) == "")
    found = {
        "containsText": c.contains(p), "notContainsText": ~c.contains(p), "beginsWith": c.startswith(p), "endsWith": c.endswith(p), "containsBlanks": blank, "notContainsBlanks": ~blank,
    }[kind]
    return F.coalesce(found, F.lit(False))


def duplicates(df: DataFrame, x: str, name: str = "duplicate") -> DataFrame:
    """Marks values that occur more than once, text without case: counts by value, then a join that splits hot values."""
    key = F.lower(F.col(x)) if dict(df.dtypes)[x] == "string" else F.col(x)
    counts = df.where(F.col(x).isNotNull()).groupBy(key.alias("_key")).agg((F.count(F.lit(1)) > 1).alias(name))
    return df.withColumn("_own", key).join(counts, F.col("_own") == F.col("_key"), "left").drop("_own", "_key").withColumn(name, F.coalesce(name, F.lit(False)))


def above_average(df: DataFrame, x: str, deviations: float = 0.0, equal: bool = False, above: bool = True, name: str = "above_average") -> DataFrame:
    """Against the mean, or so many population deviations from it."""
    stats = F.broadcast(df.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s")))  # one row
    edge = F.col("_m") + (deviations if above else -deviations) * F.col("_s")
    hit = (F.col(x) > edge if above else F.col(x) < edge) | ((F.col(x) == edge) if equal else F.lit(False))
    return df.join(stats).withColumn(name, F.coalesce(hit, F.lit(False))).drop("_m", "_s")


def first_rule(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule, by priority, that holds."""
    return reduce(lambda rest, r: F.when(r[1], F.lit(r[0])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def valid(x: str, kind: str, operator: str = "between", a=None, b=None, allow_blank: bool = True, items: list | None = None) -> Column:
    """Data validation of kinds whole, decimal, list, textLength, date and time; an unknown kind passes."""
    c = F.col(x)
    blank = c.isNull() | (c.cast("string") == "")
    if kind in ("whole", "decimal"):
        n = c.try_cast("double")
        ok = OPERATORS[operator](n, F.lit(a), F.lit(b)) & ((n == F.floor(n)) if kind == "whole" else F.lit(True))
    elif kind == "textLength":
        ok = OPERATORS[operator](F.length(c.cast("string")), F.lit(a), F.lit(b))
    elif kind == "list":
        ok = F.lower(c.cast("string")).isin([str(i).lower() for i in items or []])
    elif kind in ("date", "time"):
        ok = OPERATORS[operator](c, F.lit(a), F.lit(b))
    else:
        ok = F.lit(True)
    return F.when(blank, F.lit(allow_blank)).otherwise(F.coalesce(ok, F.lit(False)))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of those they break."""
    broken = F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, cells, empty, numbers, texts, sum, average, min, max) of a range, in one scan."""
    types = dict(df.dtypes)
    parts = []
    for c in columns:
        numeric = types[c] not in ("string", "boolean")
        v = F.col(c).cast("double") if numeric and types[c] not in ("date", "timestamp", "timestamp_ntz") else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("cells"), F.count_if(F.col(c).isNull()).alias("empty"), F.count(c).alias("filled"), F.sum(v).alias("sum"), F.avg(v).alias("average"), F.min(v).alias("min"), F.max(v).alias("max")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def find(df: DataFrame, keys: list[str], value: str, match: str = "contains", columns: list[str] | None = None) -> DataFrame:
    """(keys..., column, value) of cells whose text matches, without case."""
    columns = columns or [c for c in df.columns if c not in keys]
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select(*keys, "x.*")
    low, v = F.lower("value"), value.lower()
    return long.where({"exact": low == v, "contains": low.contains(v), "startsWith": low.startswith(v), "endsWith": low.endswith(v)}[match])


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., change, column, before, after): rows added or removed, and cells that changed."""
    columns = [c for c in before.columns if c in after.columns and c not in keys]
    a = before.select(*(F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("_a"))
    b = after.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)), F.struct(*(F.col(c).cast("string").alias(c) for c in columns)).alias("_b"))
    joined = a.join(b, reduce(lambda x, y: x & y, (F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys)))), "full")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_a.{c}").alias("before"), F.col(f"_b.{c}").alias("after")) for c in columns))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    whole = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    changed = F.filter(cells, lambda x: ~x["before"].eqNullSafe(x["after"]))
    out = joined.select(*(F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)), change.alias("change"), F.explode(F.when(change == "changed", changed).otherwise(whole)).alias("x"))
    return out.select(*keys, "change", "x.*")
