"""Sequential model confidence sets by betting on loss differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augurline.functions.checks import finite, labels, probability
from augurline.functions.losses import log_sum_exp, pair_difference

ROWS = "series_id string, t long, model string, model_ord int, log_evalue double, log_adjusted double, retained boolean, n_updates long"


def closed(log_e: Sequence[float]) -> np.ndarray:
    """Log e-values adjusted by closure over arithmetic means.

    A model's adjusted value is the least mean over the subsets that hold it; the least is reached with the smallest other values.
    """
    e = np.asarray(log_e, float)
    order = np.argsort(e, kind="stable")
    out = np.empty(len(e))
    for i in range(len(e)):
        others = e[order[order != i]]
        sums = np.logaddexp.accumulate(np.concatenate([[e[i]], others]))
        out[i] = (sums - np.log(np.arange(1, len(sums) + 1))).min()
    return out


def difference(actual: float, a: float, b: float, quantile: float | None) -> float:
    if a == b:
        return 0.0
    low, high = min(a, b), max(a, b)
    part = (min(max(actual, low), high) - low) / (high - low)
    sign = 1.0 if a < b else -1.0
    return sign * (2 * part - 1) if quantile is None else sign * (part - (1 - quantile)) / max(quantile, 1 - quantile)


class SequentialModelConfidenceSet:
    """Keeps a model until the evidence against it passes -log(alpha); one outcome after each set of forecasts."""

    def __init__(self, names: Sequence[str], alpha: float = 0.1, bet: float = 0.5, quantile: float | None = None):
        self.names = labels(list(names))
        if len(self.names) < 2 or not 0 < finite(bet, "bet") < 1:
            raise ValueError("two models and a bet inside (0, 1) are needed")
        self.alpha, self.bet, self.quantile = probability(alpha, "alpha"), bet, quantile
        m = len(self.names)
        self.wealth = [[-math.inf if i == j else 0.0 for j in range(m)] for i in range(m)]
        self.log_e, self.adjusted, self.retained, self.n, self.pending = [0.0] * m, [0.0] * m, [True] * m, 0, None

    @property
    def confidence_set(self) -> list[str]:
        return [n for n, kept in zip(self.names, self.retained, strict=True) if kept]

    def predict(self, points: Sequence[float]) -> None:
        if self.pending is not None:
            raise RuntimeError("forecasts are waiting for their outcome")
        if len(points) != len(self.names):
            raise ValueError("one forecast for each model")
        self.pending = [finite(p, "forecast") for p in points]

    def update(self, actual: float) -> None:
        if self.pending is None:
            raise RuntimeError("no forecasts are waiting")
        y, f, m = finite(actual, "actual"), self.pending, len(self.names)
        if any(p != f[0] for p in f):
            wealth = [[w if i == j else w + math.log1p(self.bet * difference(y, f[i], f[j], self.quantile)) for j, w in enumerate(row)] for i, row in enumerate(self.wealth)]
            log_e = [float(np.logaddexp.reduce(row)) - math.log(m - 1) for row in wealth]
            adjusted = closed(log_e).tolist()
            self.wealth, self.log_e, self.adjusted = wealth, log_e, adjusted
            self.retained = [kept and a < -math.log(self.alpha) for kept, a in zip(self.retained, adjusted, strict=True)]
        self.n, self.pending = self.n + 1, None


def confidence_sets(rows: DataFrame, models: Sequence[str], *, alpha: float = 0.1, bet: float = 0.5, quantile: float | None = None) -> DataFrame:
    """ROWS after every outcome, as window sums of log1p and array functions in the JVM.

    rows: series_id, t, actual, forecasts (map of model to forecast).  Exclusion is for good.
    """
    names = labels(list(models))
    m, line = len(names), Window.partitionBy("series_id").orderBy("t")
    f = [F.col("forecasts")[n] for n in names]
    pairs = {(i, j): F.sum(F.log1p(F.lit(float(bet)) * pair_difference(F.col("actual"), f[i], f[j], quantile))).over(line) for i in range(m) for j in range(m) if i != j}
    wealth = rows.select("series_id", "t", F.row_number().over(line).cast("long").alias("n_updates"), *(v.alias(f"w{i}_{j}") for (i, j), v in pairs.items()))
    e = [log_sum_exp(F.array(*(F.col(f"w{i}_{j}") for j in range(m) if j != i))) - math.log(m - 1) for i in range(m)]
    ranked = wealth.select("series_id", "t", "n_updates", *(v.alias(f"e{i}") for i, v in enumerate(e)))
    adjusted = []
    for i in range(m):
        others = F.array_sort(F.array(*(F.col(f"e{j}") for j in range(m) if j != i)))
        sets = [log_sum_exp(F.concat(F.array(F.col(f"e{i}")), F.slice(others, 1, k))) - math.log(k + 1) for k in range(m)]
        adjusted.append(F.array_min(F.array(F.col(f"e{i}"), *sets[1:])))
    cells = F.array(*(F.struct(F.lit(n).alias("model"), F.lit(i).alias("model_ord"), F.col(f"e{i}").alias("log_evalue"), adjusted[i].alias("log_adjusted")) for i, n in enumerate(names)))
    long = ranked.select("series_id", "t", "n_updates", F.explode(cells).alias("c")).select("series_id", "t", "c.*", "n_updates")
    kept = F.min(F.col("log_adjusted") < -math.log(alpha)).over(Window.partitionBy("series_id", "model").orderBy("t"))
    return long.select("series_id", "t", "model", "model_ord", "log_evalue", "log_adjusted", kept.alias("retained"), "n_updates")


def sequential_compare(test: DataFrame, lead_time: int, models: Sequence[str], **options) -> DataFrame:
    """Confidence sets over one lead of a backtest whose forecasts don't overlap (origins at least a lead apart; else it fails)."""
    one = test.where(F.col("lead_time") == lead_time)
    rows = one.groupBy("series_id", "origin").agg(F.max("actual").alias("actual"), F.map_from_entries(F.collect_list(F.struct("model", "forecast"))).alias("forecasts"))
    apart = F.col("origin") - F.lag("origin").over(Window.partitionBy("series_id").orderBy("origin"))
    checked = F.when(F.coalesce(apart, F.lit(lead_time)) >= lead_time, F.col("actual")).otherwise(F.raise_error(F.lit("forecasts overlap")).cast("double"))
    return confidence_sets(rows.select("series_id", F.col("origin").alias("t"), checked.alias("actual"), "forecasts"), models, **options)


def replay(rows: DataFrame, models: Sequence[str], **options) -> DataFrame:
    """The same rows by the tracker itself, a group per series; for many models."""
    names = list(models)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, out = SequentialModelConfidenceSet(names, **options), []
        for row in pdf.sort_values("t").itertuples():
            tracker.predict([dict(row.forecasts)[n] for n in names])
            tracker.update(row.actual)
            out += [(row.series_id, row.t, n, i, tracker.log_e[i], tracker.adjusted[i], tracker.retained[i], tracker.n) for i, n in enumerate(names)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])

    return rows.groupBy("series_id").applyInPandas(run, ROWS)
