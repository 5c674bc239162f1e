"""FORECAST.ETS and its kin: additive trend, multiplicative season, by exponential smoothing.

Spark puts one value at each time of each series first; a series' values, one for each step of
its timeline, are then smoothed in one pass for all parameters of the grid at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The grid that level, trend and season are smoothed with, and what is tried first; fixed values.
LEVELS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
TRENDS = SEASONS = (0.01, 0.05, 0.1, 0.2, 0.3, 0.5)
FIRST = (0.3, 0.05, 0.0)
#: How values of one time become one, by code; fixed values.
AGGREGATES = {1: F.avg, 2: F.count, 3: F.count, 4: F.max, 5: F.median, 6: F.min, 7: F.sum}


def timeline(time: np.ndarray, value: np.ndarray, fill_zero: bool) -> tuple[np.ndarray, float] | None:
    """(values at all steps, step) of sorted distinct times; None where times are no multiples of the least step."""
    gaps = np.diff(time)
    step = float(gaps.min()) if len(gaps) else 1.0
    at = (time - time[0]) / step
    if np.abs(np.diff(at) - np.round(np.diff(at))).max(initial=0) > 1e-9:
        return None
    at = np.round(at).astype(int)
    every = np.arange(at[-1] + 1)
    full = np.zeros(len(every)) if fill_zero else np.interp(every, at, value)
    full[at] = value
    return full, step


def period_of(values: np.ndarray) -> int:
    """The lag of the first peak of the autocorrelation that is significant, else 1."""
    n = len(values)
    centred = values - values.mean()
    power = float(centred @ centred)
    if n < 6 or power == 0:
        return 1
    lags = np.arange(1, n // 2 + 1)
    acf = np.array([centred[:-k] @ centred[k:] for k in lags]) / power
    inner = np.arange(1, len(acf) - 1)
    peaks = inner[(acf[inner] > acf[inner - 1]) & (acf[inner] > acf[inner + 1]) & (acf[inner] > 1.96 / math.sqrt(n))]
    return int(peaks[0] + 1) if len(peaks) else 1


class Smoothed:
    """The parameters of the grid with the least mean squared error, and where they leave a series."""

    def __init__(self, values: np.ndarray, period: int) -> None:
        seasonal = period > 1
        grid = [FIRST] + [(a, b, g) for a in LEVELS for b in TRENDS for g in (SEASONS if seasonal else (0.0,))]
        alpha, beta, gamma = np.array(grid).T
        k = len(grid)
        if seasonal:
            head, second = values[:period], values[period : 2 * period]
            level, trend = np.full(k, head.mean()), np.full(k, (second - head).mean() / period)
            season = np.tile(head / head.mean() if head.mean() else np.ones(period), (k, 1))
        else:
            level, trend, season = np.full(k, values[0]), np.full(k, values[1] - values[0]), np.ones((k, 1))
        missed = np.empty((len(values), k))
        safe = lambda x: np.where(x == 0, 1.0, x)
        for t, y in enumerate(values):
            s = safe(season[:, t % period])
            missed[t] = y - (level + trend) * s
            new = alpha * (y / s) + (1 - alpha) * (level + trend)
            trend = beta * (new - level) + (1 - beta) * trend
            level = new
            if seasonal:
                season[:, t % period] = gamma * (y / safe(level)) + (1 - gamma) * s
        error = (missed[1:] ** 2).mean(0)
        best = int(np.argmin(error))
        self.alpha, self.beta, self.gamma = (float(x) for x in grid[best])
        self.mse, self.missed = float(error[best]), missed[:, best]
        self.level, self.trend, self.season, self.period, self.n = float(level[best]), float(trend[best]), season[best], period, len(values)

    def ahead(self, steps: int) -> float:
        s = self.season[(self.n - 1 + steps) % self.period]
        return (self.level + steps * self.trend) * (s if s else 1.0)


def _series(df: DataFrame, by: list[str], time: str, value: str, aggregation: int, run, schema: str) -> DataFrame:
    """``run(key, times, values)`` gives rows for each series; times are numbers, dates count in days and timestamps in seconds."""
    kind = dict(df.dtypes)[time]
    at = F.unix_date(F.col(time)) if kind == "date" else F.unix_micros(F.col(time).cast("timestamp")) / 1e6 if kind.startswith("timestamp") else F.col(time)
    some = df.select(*by, at.cast("double").alias("_t"), F.col(value).cast("double").alias("_v")).where("_t is not null and _v is not null")
    each = some.groupBy(*by, "_t").agg(AGGREGATES[aggregation]("_v").cast("double").alias("_v"))
    names = [*by, *(x.split()[0] for x in schema.split(", "))]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_t")
        return pd.DataFrame([(*key, *r) for r in run(rows["_t"].to_numpy(), rows["_v"].to_numpy())], columns=names)

    types = dict(df.dtypes)
    return each.groupBy(*by).applyInPandas(one, ", ".join([*(f"`{b}` {types[b]}" for b in by), schema]))


def _model(time: np.ndarray, value: np.ndarray, seasonality: int, fill_zero: bool) -> tuple[Smoothed, np.ndarray, float] | None:
    made = timeline(time, value, fill_zero) if len(time) >= 3 else None
    if made is None:
        return None
    period = period_of(made[0]) if seasonality == 1 else max(1, seasonality)
    if period > 1 and len(made[0]) < 2 * period:
        return None
    return Smoothed(made[0], period), made[0], made[1]


def ets(df: DataFrame, by: list[str], time: str, value: str, steps: int = 1, seasonality: int = 1, fill_zero: bool = False, aggregation: int = 1, confidence: float = 0.95) -> DataFrame:
    """FORECAST.ETS and .CONFINT: (by..., step, forecast, interval) of the next ``steps`` steps of each series.

    ``seasonality`` 1 finds the period, 0 has none.  Missing steps are filled in by a line, or
    by zero.  A series of fewer than three times, of uneven times or of fewer than two periods
    has no rows.  Null times and values do not count.
    """
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)

    def run(t: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
        found = _model(t, v, seasonality, fill_zero)
        for k in range(1, steps + 1) if found else ():
            yield k, found[0].ahead(k), z * math.sqrt(found[0].mse * k)

    return _series(df, by, time, value, aggregation, run, "step int, forecast double, interval double")


def ets_seasonality(df: DataFrame, by: list[str], time: str, value: str, fill_zero: bool = False, aggregation: int = 1) -> DataFrame:
    """FORECAST.ETS.SEASONALITY: (by..., period) of each series."""

    def run(t: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
        made = timeline(t, v, fill_zero) if len(t) >= 3 else None
        if made:
            yield (period_of(made[0]),)

    return _series(df, by, time, value, aggregation, run, "period int")


def ets_stat(df: DataFrame, by: list[str], time: str, value: str, seasonality: int = 1, fill_zero: bool = False, aggregation: int = 1) -> DataFrame:
    """FORECAST.ETS.STAT: (by..., alpha, beta, gamma, mase, smape, mae, rmse, step) of each series."""

    def run(t: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
        found = _model(t, v, seasonality, fill_zero)
        if found:
            m, values, step = found
            missed = np.abs(m.missed[1:])
            naive = np.abs(np.diff(values)).mean()
            size = (np.abs(values[1:]) + np.abs(values[1:] - m.missed[1:])) / 2
            smape = 100 * float(np.divide(missed, size, out=np.zeros(len(missed)), where=size != 0).mean())
            yield m.alpha, m.beta, m.gamma, float(missed.mean() / naive) if naive else 0.0, smape, float(missed.mean()), math.sqrt(m.mse), step

    return _series(df, by, time, value, aggregation, run, "alpha double, beta double, gamma double, mase double, smape double, mae double, rmse double, step double")
