"""Aggregates of columns, as columns for ``df.agg`` or ``groupBy().agg``.

A column is a range: only numbers, dates and booleans in columns of their own count; null is
empty.  One call of ``agg`` may hold any number of these: they share one scan and one
partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def sum_(x) -> Column:
    return _zero(F.sum(_c(x).cast("double")))


def average(x) -> Column:
    """Null (a ``#DIV/0!``) of nothing."""
    return F.avg(_c(x).cast("double"))


def count(x) -> Column:
    return F.count(_c(x).cast("double"))


def counta(x) -> Column:
    return F.count(_c(x))


def countblank(x) -> Column:
    return F.count_if(_c(x).isNull() | (_c(x).cast("string") == ""))


def min_(x) -> Column:
    return _zero(F.min(_c(x).cast("double")))


def max_(x) -> Column:
    return _zero(F.max(_c(x).cast("double")))


def product(x) -> Column:
    return _zero(F.product(_c(x).cast("double")))


def sumproduct(*xs) -> Column:
    return _zero(F.sum(reduce(lambda a, b: a * b, (F.coalesce(_c(x).cast("double"), F.lit(0.0)) for x in xs))))


def sumsq(x) -> Column:
    return _zero(F.sum(_c(x) * _c(x)))


def sumx2my2(x, y) -> Column:
    return F.sum(_c(x) * _c(x) - _c(y) * _c(y))


def sumx2py2(x, y) -> Column:
    return F.sum(_c(x) * _c(x) + _c(y) * _c(y))


def sumxmy2(x, y) -> Column:
    return F.sum((_c(x) - _c(y)) * (_c(x) - _c(y)))


# Statistics.

stdev_s = lambda x: F.stddev_samp(_c(x))
stdev_p = lambda x: F.stddev_pop(_c(x))
var_s = lambda x: F.var_samp(_c(x))
var_p = lambda x: F.var_pop(_c(x))
median = lambda x: F.median(_c(x))
geomean = lambda x: F.when(F.min(_c(x)) > 0, F.exp(F.avg(F.ln(_c(x)))))
harmean = lambda x: F.when(F.min(_c(x)) > 0, F.count(_c(x)) / F.sum(1 / _c(x)))
devsq = lambda x: F.var_pop(_c(x)) * F.count(_c(x))
slope = lambda y, x: F.regr_slope(_c(y), _c(x))
intercept = lambda y, x: F.regr_intercept(_c(y), _c(x))
rsq = lambda y, x: F.regr_r2(_c(y), _c(x))
correl = lambda y, x: F.corr(_c(y), _c(x))
covariance_p = lambda y, x: F.covar_pop(_c(y), _c(x))
covariance_s = lambda y, x: F.covar_samp(_c(y), _c(x))


def percentiles(x, shares: list[float]) -> list[Column]:
    """PERCENTILE.INC for each of several shares, all from one pass over a group's distinct values."""
    found = F.percentile(_c(x), F.array(*(F.lit(float(p)) for p in shares)))
    return [F.get(found, F.lit(i)) for i in range(len(shares))]


def percentile_inc(x, p: float) -> Column:
    return F.percentile(_c(x), p)


def quartile_inc(x, q: int) -> Column:
    return F.percentile(_c(x), q / 4)


def steyx(y, x) -> Column:
    y, x = _c(y), _c(x)
    n = F.regr_count(y, x)
    return F.when(n > 2, F.sqrt((F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.regr_sxx(y, x)) / (n - 2)))


def forecast(at: float, y, x) -> Column:
    return intercept(y, x) + slope(y, x) * at


def skew(x) -> Column:
    n = F.count(_c(x))
    return F.when(n >= 3, F.skewness(_c(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def skew_p(x) -> Column:
    return F.when(F.count(_c(x)) >= 3, F.skewness(_c(x)))


def kurt(x) -> Column:
    n = F.count(_c(x))
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(_c(x)) + 6))


def prob(x, p, low: float, high: float | None = None) -> Column:
    return F.sum(F.when(_c(x).between(low, low if high is None else high), _c(p)).otherwise(0.0))


# A-forms count text as 0 and booleans as 0 or 1.


def a_value(x) -> Column:
    c = _c(x)
    kind = F.typeof(c)
    return F.when(c.isNull(), None).when(kind == "string", 0.0).otherwise(F.coalesce(c.try_cast("double"), F.lit(0.0)))


averagea = lambda x: F.avg(a_value(x))
maxa = lambda x: _zero(F.max(a_value(x)))
mina = lambda x: _zero(F.min(a_value(x)))
stdeva = lambda x: F.stddev_samp(a_value(x))
stdevpa = lambda x: F.stddev_pop(a_value(x))
vara = lambda x: F.var_samp(a_value(x))
varpa = lambda x: F.var_pop(a_value(x))


# Conditional aggregates: predicates come from criteria.matches.


def sumif(predicate: Column, x) -> Column:
    return _zero(F.sum(F.when(predicate, _c(x).cast("double"))))


def countif(predicate: Column) -> Column:
    return F.count_if(predicate)


def averageif(predicate: Column, x) -> Column:
    return F.avg(F.when(predicate, _c(x).cast("double")))


def minif(predicate: Column, x) -> Column:
    return _zero(F.min(F.when(predicate, _c(x).cast("double"))))


def maxif(predicate: Column, x) -> Column:
    return _zero(F.max(F.when(predicate, _c(x).cast("double"))))


#: SUBTOTAL codes; 101 to 111 are the same over rows that are not hidden either.
SUBTOTAL = {1: average, 2: count, 3: counta, 4: max_, 5: min_, 6: product, 7: stdev_s, 8: stdev_p, 9: sum_, 10: var_s, 11: var_p}


def subtotal(code: int, x, filtered: Column | None = None, hidden: Column | None = None) -> Column:
    """Aggregate by code over rows that no filter hides and, for codes above 100, that are not hidden by hand."""
    shown = ~F.coalesce(filtered, F.lit(False)) if filtered is not None else F.lit(True)
    if code > 100 and hidden is not None:
        shown = shown & ~F.coalesce(hidden, F.lit(False))
    return SUBTOTAL[code % 100](F.when(shown, _c(x)))


def aggregate(code: int, x, hidden: Column | None = None, error: Column | None = None, option: int = 0, k: float | None = None) -> Column:
    """AGGREGATE: codes 1-19; odd options skip hidden rows, options 2, 3, 6 and 7 skip errors."""
    shown = F.lit(True)
    if option % 2 and hidden is not None:
        shown = shown & ~F.coalesce(hidden, F.lit(False))
    if option in (2, 3, 6, 7) and error is not None:
        shown = shown & error.isNull()
    v = F.when(shown, _c(x))
    if code in SUBTOTAL:
        return SUBTOTAL[code](v)
    ordered = F.sort_array(F.collect_list(v)) if code in (14, 15, 18, 19) else None
    return {
        12: lambda: F.median(v), 13: lambda: F.mode(v, True), 14: lambda: F.get(ordered, F.size(ordered) - int(k or 1)), 15: lambda: F.get(ordered, F.lit(int(k or 1) - 1)),
        16: lambda: F.percentile(v, k), 17: lambda: F.percentile(v, (k or 0) / 4), 18: lambda: exclusive(ordered, k), 19: lambda: exclusive(ordered, (k or 0) / 4),
    }[code]()


def exclusive(ordered: Column, p: float) -> Column:
    """PERCENTILE.EXC of a sorted array."""
    n = F.size(ordered)
    at = F.lit(float(p)) * (n + 1)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low - 1), F.get(ordered, low)
    return F.when((at >= 1) & (at <= n), a + (at - low) * (F.coalesce(b, a) - a))
