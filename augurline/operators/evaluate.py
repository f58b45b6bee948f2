"""Scoring, selection and comparison of backtests."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from augurline.functions.losses import forecast_loss
from augurline.operators import bootstrap
from augurline.operators.backtest import backtest
from augurline.operators.splits import Rolling


def with_losses(test: DataFrame, loss: str = "squared", quantile: float | None = None) -> DataFrame:
    return test.withColumn("loss", forecast_loss(F.col("actual"), F.col("forecast"), loss, quantile))


def evaluate(test: DataFrame, loss: str = "squared", quantile: float | None = None) -> DataFrame:
    """Mean loss of each series, lead and model; leads are never pooled.  Folds of a series with other leads or models than its others fail."""
    scored = with_losses(test, loss, quantile)
    cells = scored.groupBy("series_id", "lead_time", "model", "model_ord").agg(F.count(F.lit(1)).alias("n_origins"), F.avg("loss").alias("mean_loss"), F.min("fold").alias("first"), F.max("fold").alias("last"))
    whole = Window.partitionBy("series_id")
    same = (F.min("n_origins").over(whole) == F.max("n_origins").over(whole)) & (F.min("first").over(whole) == F.max("first").over(whole)) & (F.min("last").over(whole) == F.max("last").over(whole))
    checked = F.when(same, F.col("mean_loss")).otherwise(F.raise_error(F.lit("all folds must have the same leads and models")).cast("double"))
    return cells.select("series_id", "lead_time", "model", "model_ord", "n_origins", checked.alias("mean_loss"))


def select_forecaster(series: DataFrame, n_train: int, models: Mapping[str, Callable], *, lead_time: int = 1, step: int = 1, window: int | None = None, loss: str = "squared", quantile: float | None = None) -> DataFrame:
    """The model with the least mean loss at one lead over the observations after the first n_train; the first of ties."""
    test = backtest(series, models, Rolling(n_train, 1, step, lead_time - 1, window))
    scores = evaluate(test, loss, quantile)
    best = F.min_by("model_ord", F.struct("mean_loss", "model_ord")).over(Window.partitionBy("series_id"))
    return scores.withColumn("selected", F.col("model_ord") == best)


def improvements(test: DataFrame, baseline: str, lead_time: int, loss: str = "squared", quantile: float | None = None) -> DataFrame:
    """The panel of loss improvements over a baseline at one lead: panel_id, t, col, name, value.

    Origins must rise by one constant step; a candidate whose improvements are all equal fails.
    """
    scored = with_losses(test.where(F.col("lead_time") == lead_time), loss, quantile)
    cell = Window.partitionBy("series_id", "fold")
    scored = scored.withColumn("base", F.max(F.when(F.col("model") == baseline, F.col("loss"))).over(cell)).withColumn("base_ord", F.max(F.when(F.col("model") == baseline, F.col("model_ord"))).over(cell))
    candidates = scored.where(F.col("model") != baseline)
    line = Window.partitionBy("series_id", "model").orderBy("fold")
    whole = Window.partitionBy("series_id", "model")
    candidates = candidates.withColumn("gap", F.col("origin") - F.lag("origin").over(line)).withColumn("value", F.col("base") - F.col("loss"))
    fine = (F.count_if(F.col("base").isNull()).over(whole) == 0) & (F.min("gap").over(whole) == F.max("gap").over(whole)) & (F.min("gap").over(whole) > 0)
    value = F.when(~F.coalesce(fine, F.lit(False)), F.raise_error(F.lit("a baseline and regularly spaced origins are needed")).cast("double"))
    value = value.when(F.min("value").over(whole) == F.max("value").over(whole), F.raise_error(F.concat(F.lit("constant loss differences: "), "model")).cast("double")).otherwise(F.col("value"))
    return candidates.select(F.col("series_id").alias("panel_id"), F.col("fold").cast("long").alias("t"), (F.col("model_ord") - (F.col("model_ord") > F.col("base_ord")).cast("int")).alias("col"), F.col("model").alias("name"), value.alias("value"))


def overlap_defaults(n: int, lead_time: int, step: int) -> tuple[int, int, bool]:
    """(lags, block length, warning) for n origins whose forecasts overlap."""
    overlap = -(-lead_time // step)
    lags = min(max(bootstrap.default_lags(n), overlap - 1), n - 2)
    return lags, min(max(bootstrap.default_block_length(n), overlap), n), overlap - 1 > n - 2


def compare_forecasts(test: DataFrame, baseline: str, lead_time: int, *, loss: str = "squared", quantile: float | None = None, alpha: float = 0.05, lags: int | None = None, block_length: float | None = None, **options) -> DataFrame:
    """Bootstrap test that candidates improve on a baseline, with mean losses and the relative improvement (null for a zero loss).

    A row per series and candidate.  The folds of each series set its default bandwidths for overlapping leads; where they overlap
    further than its origins reach, that is among the warnings.
    """
    at = test.where(F.col("lead_time") == lead_time)
    panel = improvements(test, baseline, lead_time, loss, quantile)
    origins = at.select("series_id", "origin").distinct()
    step = F.col("origin") - F.lag("origin").over(Window.partitionBy("series_id").orderBy("origin"))
    shape = origins.withColumn("step", step).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("step"))
    # Bandwidths depend on (n, step) alone, of which series share a few.
    shapes = sorted(tuple(x) for x in shape.select("n", "step").distinct().collect())
    parts = []
    for n, gap in shapes:
        own_lags, own_block, far = overlap_defaults(n, lead_time, gap or 1)
        own = panel.join(shape.where((F.col("n") == n) & F.col("step").eqNullSafe(gap)).select(F.col("series_id").alias("panel_id")), "panel_id", "left_semi") if len(shapes) > 1 else panel
        found = bootstrap.test_returns(own, alpha=alpha, lags=own_lags if lags is None else lags, block_length=own_block if block_length is None else block_length, **options)
        parts.append(found.withColumn("warnings", F.concat("warnings", F.array(F.lit("forecasts overlap further than the origins reach")))) if far else found)
    if not parts:
        raise ValueError(f"the backtest has no forecasts at lead {lead_time}")
    losses = evaluate(at, loss, quantile)
    base = losses.where(F.col("model") == baseline).select(F.col("series_id").alias("panel_id"), F.col("mean_loss").alias("baseline_loss"))
    own = losses.select(F.col("series_id").alias("panel_id"), F.col("model").alias("name"), "mean_loss")
    out = functools.reduce(DataFrame.unionByName, parts).join(own, ["panel_id", "name"]).join(base, "panel_id").withColumnsRenamed({"name": "model", "mean": "mean_improvement"})
    return out.withColumn("relative_improvement", F.when(F.col("baseline_loss") != 0, F.col("mean_improvement") / F.col("baseline_loss")))


def accuracy(test: DataFrame) -> DataFrame:
    """MAE and RMSE of each series, lead and model."""
    error = F.col("actual") - F.col("forecast")
    return test.groupBy("series_id", "lead_time", "model", "model_ord").agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))


def mase_scale(series: DataFrame, n_train: int, period: int) -> DataFrame:
    """Mean absolute seasonal difference of the training segment alone; null where it is 0."""
    line = Window.partitionBy("series_id").orderBy("t")
    step = F.abs(F.col("y") - F.lag("y", period).over(line))
    means = series.where(F.col("t") < n_train).select("series_id", step.alias("d")).groupBy("series_id").agg(F.avg("d").alias("scale"))
    return means.withColumn("scale", F.when(F.col("scale") != 0, F.col("scale")))
