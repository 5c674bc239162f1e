"""Hypothesis tests and fitted lines over columns: moments by one aggregate, tails by the distribution functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.cell import call
from tessella.functions.distributions import t_cdf
from tessella.functions.engineering import vectorised


def t_test(df: DataFrame, x: str, y: str, tails: int = 2, kind: int = 2) -> DataFrame:
    """T.TEST of two columns: kind 1 paired, 2 of equal and 3 of unequal variance; one row ``p``."""
    if kind == 1:
        d = F.col(x) - F.col(y)
        m = df.agg(F.avg(d).alias("m"), F.var_samp(d).alias("v"), F.count(d).alias("n"))
        m = m.select((F.abs("m") / F.sqrt(F.col("v") / F.col("n"))).alias("t"), (F.col("n") - 1).cast("double").alias("df"))
    else:
        m = df.agg(*(f(c).alias(f"{name}{c_}") for c_, c in (("x", x), ("y", y)) for name, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
        a, b = F.col("vx") / F.col("nx"), F.col("vy") / F.col("ny")
        if kind == 2:
            pooled = ((F.col("nx") - 1) * F.col("vx") + (F.col("ny") - 1) * F.col("vy")) / (F.col("nx") + F.col("ny") - 2)
            spread, df_ = F.sqrt(pooled * (1 / F.col("nx") + 1 / F.col("ny"))), F.col("nx") + F.col("ny") - 2
        else:
            spread, df_ = F.sqrt(a + b), F.pow(a + b, 2) / (a * a / (F.col("nx") - 1) + b * b / (F.col("ny") - 1))
        m = m.select((F.abs(F.col("mx") - F.col("my")) / spread).alias("t"), df_.cast("double").alias("df"))
    # Welch's degrees of freedom are not whole, so the tail is taken without rounding them.
    return m.select(((1 - vectorised(t_cdf)(F.col("t"), F.col("df"))) * tails).alias("p"))


def f_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """F.TEST: twice the tail of the larger variance over the smaller, 1 at most."""
    m = df.agg(F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.count(x).alias("nx"), F.count(y).alias("ny"))
    up = F.col("vx") >= F.col("vy")
    ratio = F.when(up, F.try_divide("vx", "vy")).otherwise(F.try_divide("vy", "vx"))
    a, b = F.when(up, F.col("nx")).otherwise(F.col("ny")) - 1, F.when(up, F.col("ny")).otherwise(F.col("nx")) - 1
    return m.select(F.least(F.lit(1.0), 2 * call("F.DIST.RT", ratio, a, b).value).alias("p"))


def chisq_test(df: DataFrame, actual: str, expected: str) -> DataFrame:
    """CHISQ.TEST with one degree of freedom less than rows."""
    m = df.agg(F.sum(F.try_divide(F.pow(F.col(actual) - F.col(expected), 2), F.col(expected))).alias("x"), F.count(actual).alias("n"))
    return m.select(call("CHISQ.DIST.RT", F.col("x"), F.col("n") - 1).value.alias("p"))


def z_test(df: DataFrame, x: str, mean: float, sigma: float | None = None) -> DataFrame:
    """Z.TEST: the upper tail of the sample's mean."""
    m = df.agg(F.avg(x).alias("m"), (F.stddev_samp(x) if sigma is None else F.lit(float(sigma))).alias("s"), F.count(x).alias("n"))
    return m.select((1 - call("NORM.S.DIST", (F.col("m") - mean) / (F.col("s") / F.sqrt("n")), 1).value).alias("p"))


def _line(y: Column, x: Column, const: bool) -> tuple[Column, Column]:
    if const:
        return F.regr_slope(y, x), F.regr_intercept(y, x)
    return F.sum(x * y) / F.sum(x * x), F.lit(0.0)


def linest(df: DataFrame, y: str, x: str) -> DataFrame:
    """LINEST of one regressor: one row of slope and intercept."""
    m, b = _line(F.col(y), F.col(x), True)
    return df.agg(m.alias("slope"), b.alias("intercept"))


def logest(df: DataFrame, y: str, x: str) -> DataFrame:
    """LOGEST: y = b * m ** x."""
    m, b = _line(F.ln(y), F.col(x), True)
    return df.agg(F.exp(m).alias("m"), F.exp(b).alias("b"))


def trend(df: DataFrame, y: str, x: str, new: DataFrame, const: bool = True, name: str = "trend") -> DataFrame:
    """TREND: ``new`` with the line's value at its ``x``."""
    m, b = _line(F.col(y), F.col(x), const)
    fit = F.broadcast(df.agg(m.alias("_m"), b.alias("_b")))  # one row
    return new.join(fit).withColumn(name, F.col("_b") + F.col("_m") * F.col(x)).drop("_m", "_b")


def growth(df: DataFrame, y: str, x: str, new: DataFrame, const: bool = True, name: str = "growth") -> DataFrame:
    """GROWTH: ``new`` with the exponential curve's value at its ``x``."""
    m, b = _line(F.ln(y), F.col(x), const)
    fit = F.broadcast(df.agg(m.alias("_m"), b.alias("_b")))  # one row
    return new.join(fit).withColumn(name, F.exp(F.col("_b") + F.col("_m") * F.col(x))).drop("_m", "_b")


def linest_many(df: DataFrame, y: str, xs: list[str], const: bool = True) -> dict[str, float]:
    """LINEST of several regressors: coefficients by name, the constant as ``""``; sums of products in one scan.

    Rows with a null do not count.  Of a singular system, the least solution.
    """
    full = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs])).select(F.col(y).cast("double").alias("y"), *(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)))
    names = [f"x{i}" for i in range(len(xs))] + (["one"] if const else [])
    full = full.withColumn("one", F.lit(1.0))
    pairs = [(a, b) for i, a in enumerate(names) for b in [*names[i:], "y"]]
    row = full.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs)).first()
    left = np.array([[row[f"{a}_{b}"] if f"{a}_{b}" in row else row[f"{b}_{a}"] for b in names] for a in names], float)
    found = np.linalg.lstsq(left, np.array([row[f"{a}_y"] for a in names], float), rcond=None)[0]
    return dict(zip([*xs, *([""] if const else [])], map(float, found), strict=True))


def avedev(df: DataFrame, x: str) -> DataFrame:
    """AVEDEV: the mean distance from the mean, one row."""
    mean = F.broadcast(df.agg(F.avg(x).alias("_m")))  # one row
    return df.select(x).join(mean).agg(F.avg(F.abs(F.col(x) - F.col("_m"))).alias("avedev"))
