"""Auto-filters: which rows a column's filter keeps."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.criteria import wildcard


def values(x: str, allowed: list, blank: bool = False) -> Column:
    """A set of values, text without case."""
    keep = F.lower(F.col(x).cast("string")).isin([str(v).lower() for v in allowed])
    return F.coalesce(keep, F.lit(False)) | (F.col(x).isNull() if blank else F.lit(False))


_COMPARE = {
    "equal": lambda c, v: c == v, "notEqual": lambda c, v: c != v, "greaterThan": lambda c, v: c > v, "greaterThanOrEqual": lambda c, v: c >= v,
    "lessThan": lambda c, v: c < v, "lessThanOrEqual": lambda c, v: c <= v,
}


def custom(x: str, conditions: list[tuple[str, object]], both: bool = True) -> Column:
    """One or two conditions; text operands of equal and notEqual may have wildcards."""

    def one(op: str, v) -> Column:
        if isinstance(v, str) and op in ("equal", "notEqual"):
            hit = F.coalesce(F.col(x).cast("string").rlike(wildcard(v)), F.lit(False))
            return hit if op == "equal" else ~hit
        return F.coalesce(_COMPARE[op](F.col(x), F.lit(v)), F.lit(False))

    return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), (one(*c) for c in conditions))


def top(df: DataFrame, x: str, n: float, largest: bool = True, percent: bool = False) -> DataFrame:
    """Top or bottom N or N percent, ties kept: a threshold by a distributed top-k, then a filter."""
    if percent:
        n = max(1, int(df.where(F.col(x).isNotNull()).count() * n / 100))
    best = df.where(F.col(x).isNotNull()).orderBy(F.desc(x) if largest else F.asc(x)).limit(int(n)).agg((F.min if largest else F.max)(x).alias("_edge"))
    joined = df.join(F.broadcast(best), (F.col(x) >= F.col("_edge")) if largest else (F.col(x) <= F.col("_edge")))  # one row
    return joined.drop("_edge")


def average(df: DataFrame, x: str, above: bool = True) -> DataFrame:
    mean = F.broadcast(df.agg(F.avg(x).alias("_mean")))  # one row
    return df.join(mean, (F.col(x) > F.col("_mean")) if above else (F.col(x) < F.col("_mean"))).drop("_mean")


def period(x: str, kind: str, today: dt.date) -> Column:
    """Relative dates (yesterday ... yearToDate), months M1-M12 and quarters Q1-Q4, half-open."""
    c = F.col(x)
    if kind[0] in "MQ" and kind[1:].isdigit():
        return F.coalesce((F.month(c) if kind[0] == "M" else F.quarter(c)) == int(kind[1:]), F.lit(False))
    monday = today - dt.timedelta(days=(today.weekday() + 1) % 7)
    month = today.replace(day=1)
    quarter = month.replace(month=(month.month - 1) // 3 * 3 + 1)

    def shift(d: dt.date, n: int) -> dt.date:
        y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
        return d.replace(year=y, month=m + 1, day=1)

    one = dt.timedelta(days=1)
    spans = {
        "yesterday": (today - one, today), "today": (today, today + one), "tomorrow": (today + one, today + 2 * one),
        "lastWeek": (monday - 7 * one, monday), "thisWeek": (monday, monday + 7 * one), "nextWeek": (monday + 7 * one, monday + 14 * one),
        "lastMonth": (shift(month, -1), month), "thisMonth": (month, shift(month, 1)), "nextMonth": (shift(month, 1), shift(month, 2)),
        "lastQuarter": (shift(quarter, -3), quarter), "thisQuarter": (quarter, shift(quarter, 3)), "nextQuarter": (shift(quarter, 3), shift(quarter, 6)),
        "lastYear": (dt.date(today.year - 1, 1, 1), dt.date(today.year, 1, 1)), "thisYear": (dt.date(today.year, 1, 1), dt.date(today.year + 1, 1, 1)),
        "nextYear": (dt.date(today.year + 1, 1, 1), dt.date(today.year + 2, 1, 1)), "yearToDate": (dt.date(today.year, 1, 1), today + one),
    }
    low, high = spans[kind]
    return F.coalesce((c >= F.lit(low)) & (c < F.lit(high)), F.lit(False))


def dates(x: str, groups: list[tuple[int, ...]]) -> Column:
    """Date groups: (year,), (year, month), (year, month, day) and so on."""
    parts = (F.year, F.month, F.dayofmonth, F.hour, F.minute, F.second)
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (p(x) == v for p, v in zip(parts, g, strict=False))) for g in groups), F.lit(False))


def icon(x: str, rank: int, edges: list[float]) -> Column:
    """The icon set's bucket of a value, by ascending edges."""
    return sum(((F.col(x) >= e).cast("int") for e in edges), F.lit(0)) == rank
