"""Forecasters.  A closed form is an expression over a window of the series; anything else is a callback on NumPy arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from augurline.functions.checks import at_least

Callback = Callable[[np.ndarray, np.ndarray], np.ndarray]


def ordered() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("t")


def _integers(leads: np.ndarray) -> np.ndarray:
    leads = np.asarray(leads, np.int64)
    if leads.ndim != 1 or not len(leads) or (leads < 1).any():
        raise ValueError("lead times must be positive integers")
    return leads


@dataclass(frozen=True)
class Naive:
    """The last value."""

    def columns(self, leads: list[int], window: int | None) -> list[Column]:
        return [F.col("y")] * len(leads)

    def __call__(self, train: np.ndarray, leads: np.ndarray) -> np.ndarray:
        return np.full(len(_integers(leads)), train[-1], float)

    def least(self) -> int:
        return 1


@dataclass(frozen=True)
class SeasonalNaive:
    """The value of the same season in the last period."""

    period: int

    def __post_init__(self):
        at_least(self.period, "period")

    def columns(self, leads: list[int], window: int | None) -> list[Column]:
        return [F.lag("y", self.period - 1 - (lead - 1) % self.period).over(ordered()) for lead in leads]

    def __call__(self, train: np.ndarray, leads: np.ndarray) -> np.ndarray:
        if len(train) < self.period:
            raise ValueError("a seasonal forecast needs a whole period")
        return np.asarray(train, float)[len(train) - self.period + (_integers(leads) - 1) % self.period]

    def least(self) -> int:
        return self.period


@dataclass(frozen=True)
class Drift:
    """The line through the first and last training value."""

    def columns(self, leads: list[int], window: int | None) -> list[Column]:
        first = F.first("y").over(ordered().rowsBetween(Window.unboundedPreceding if window is None else 1 - window, 0))
        n = F.col("t") + 1 if window is None else F.least(F.col("t") + 1, F.lit(window))
        slope = (F.col("y") - first) / (n - 1)
        return [F.col("y") + lead * slope for lead in leads]

    def __call__(self, train: np.ndarray, leads: np.ndarray) -> np.ndarray:
        if len(train) < 2:
            raise ValueError("a drift needs two values")
        return train[-1] + _integers(leads) * ((train[-1] - train[0]) / (len(train) - 1))

    def least(self) -> int:
        return 2


@dataclass(frozen=True)
class Autoregression:
    """Least squares on own lags (1..p, or a tuple of lags) with an unpenalised intercept; minimum norm where not unique."""

    lags: int | tuple[int, ...]
    ridge: float = 0.0

    def __post_init__(self):
        for lag in self.own():
            at_least(lag, "lag")
        if self.ridge < 0:
            raise ValueError("ridge must not be negative")

    def own(self) -> tuple[int, ...]:
        return tuple(range(1, self.lags + 1)) if isinstance(self.lags, int) else tuple(self.lags)

    def least(self) -> int:
        return max(self.own()) + len(self.own()) + 1

    def __call__(self, train: np.ndarray, leads: np.ndarray) -> np.ndarray:
        leads, y = _integers(leads), np.asarray(train, float)
        if len(y) < self.least():
            raise ValueError(f"this autoregression needs {self.least()} observations")
        size = np.abs(y).max()
        x = y / size if size else y
        centre = x.mean()
        spread = np.abs(x - centre).max()
        if spread == 0:
            return np.full(len(leads), y[-1])
        z, lags = (x - centre) / spread, np.array(self.own())
        deepest = int(lags.max())
        targets = z[deepest:]
        design = np.lib.stride_tricks.sliding_window_view(z, deepest)[: len(targets)][:, deepest - lags]
        shift, level = design.mean(axis=0), targets.mean()
        left, right = design - shift, targets - level
        if self.ridge:
            left, right = np.vstack([left, np.sqrt(self.ridge) * np.eye(len(lags))]), np.append(right, np.zeros(len(lags)))
        weights = np.linalg.lstsq(left, right, rcond=None)[0]
        path, intercept = list(z[-deepest:]), level - shift @ weights
        for _ in range(int(leads.max())):
            path.append(float(intercept + sum(w * path[-lag] for w, lag in zip(weights, lags, strict=True))))
        return (np.array(path)[deepest - 1 + leads] * spread + centre) * size


@dataclass(frozen=True)
class Differenced:
    """Another forecaster on the differences at a period, summed up again from the last values."""

    model: Callback
    period: int = 1

    def __post_init__(self):
        at_least(self.period, "period")

    def __call__(self, train: np.ndarray, leads: np.ndarray) -> np.ndarray:
        leads, y, p = _integers(leads), np.asarray(train, float), self.period
        if len(y) <= p:
            raise ValueError("differences need more observations than the period")
        steps = np.asarray(self.model(y[p:] - y[:-p], np.arange(1, leads.max() + 1)), float)
        path = list(y[-p:])
        for step in steps:
            path.append(path[-p] + step)
        return np.array(path)[p - 1 + leads]

    def least(self) -> int:
        return self.period + getattr(self.model, "least", lambda: 1)()


@dataclass(frozen=True)
class Windowed:
    """Another forecaster on the last observations only."""

    model: Callback
    window: int

    def __call__(self, train: np.ndarray, leads: np.ndarray) -> np.ndarray:
        return self.model(train[-self.window :], leads)
