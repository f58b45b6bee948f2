"""Rolling-origin backtests in long form, and the import of saved forecasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurline.functions.checks import finite_values, labels
from augurline.operators.forecasters import ordered
from augurline.operators.splits import Rolling

SCHEMA = "series_id string, fold int, origin long, lead_time long, target_index long, model string, model_ord int, actual double, forecast double"
COLUMNS = ["series_id", "fold", "origin", "lead_time", "target_index", "model", "model_ord", "actual", "forecast"]


def series_of(df: DataFrame, key: str | None, order: list[str], value: str) -> DataFrame:
    """(series_id, t, y) of a table: positions from 0 in the given order, never calendar steps; null and nonfinite values fail."""
    from pyspark.sql import Window

    name = F.col(key).cast("string") if key else F.lit("all")
    t = F.row_number().over(Window.partitionBy("series_id").orderBy(*order)) - 1
    rows = df.withColumn("series_id", name).withColumn("t", t.cast("long")).select("series_id", "t", F.col(value).cast("double").alias("y"))
    return finite_values(rows, "y")


def backtest(series: DataFrame, models: Mapping[str, Callable], rolling: Rolling, folds_per_task: int | None = None) -> DataFrame:
    """Forecasts of all models at all folds of all series: COLUMNS, model_ord by the order of the mapping.

    series: series_id, t (0, 1, ...), y.  Where every model is a closed form, one window over each series makes all forecasts and
    nothing leaves the JVM.  Otherwise each series is a row for the callbacks (or each run of folds_per_task folds with the history they
    need a group), which get copies of the training values and the physical lead times.
    """
    names = labels(list(models))
    if all(hasattr(m, "columns") for m in models.values()):
        return _closed(series, dict(zip(names, models.values(), strict=True)), rolling)
    return _called(series, dict(models), rolling, folds_per_task)


def _closed(series: DataFrame, models: Mapping[str, Callable], rolling: Rolling) -> DataFrame:
    leads, r = list(rolling.leads), rolling
    needed = max(m.least() for m in models.values())
    if min(r.initial, r.window or r.initial) < needed:
        raise ValueError(f"these models need {needed} training observations")
    cells = []
    columns = {name: m.columns(leads, r.window) for name, m in models.items()}
    for k, lead in enumerate(leads):
        for order, name in enumerate(models):
            cells.append(F.struct(F.lit(lead).cast("long").alias("lead_time"), F.lit(name).alias("model"), F.lit(order).alias("model_ord"), F.lead("y", lead).over(ordered()).alias("actual"), columns[name][k].alias("forecast")))
    last = F.lead("y", leads[-1]).over(ordered())
    rows = series.select("series_id", "t", F.array(*cells).alias("cells"), last.isNotNull().alias("whole"))
    at = F.col("t") - (r.initial - 1)
    rows = rows.where((at >= 0) & (at % r.step == 0) & F.col("whole"))
    rows = rows.select("series_id", F.expr(f"cast((t - {r.initial - 1}) div {r.step} as int)").alias("fold"), F.col("t").alias("origin"), F.explode("cells").alias("c"))
    return rows.select("series_id", "fold", "origin", "c.lead_time", (F.col("origin") + F.col("c.lead_time")).alias("target_index"), "c.model", "c.model_ord", "c.actual", "c.forecast")


def _called(series: DataFrame, models: dict[str, Callable], rolling: Rolling, folds_per_task: int | None) -> DataFrame:
    r, leads = rolling, np.array(rolling.leads, np.int64)

    def forecasts(series_id: str, y: np.ndarray, first: int, folds: range) -> tuple:
        """(series_id, folds, forecasts by fold, model and lead, actuals by fold and lead); y begins at position `first`."""
        values = np.empty((len(folds), len(models), len(leads)))
        stops = r.initial + np.arange(folds.start, folds.stop) * r.step
        for i, stop in enumerate(stops.tolist()):
            train = y[(0 if r.window is None else max(0, stop - r.window)) - first : stop - first]
            for order, (name, model) in enumerate(models.items()):
                try:
                    found = np.asarray(model(train.copy(), leads.copy()), float)
                    if found.shape != leads.shape or not np.isfinite(found).all():
                        raise ValueError("it must return one finite value for each lead time")
                except Exception as error:
                    raise RuntimeError(f"model {name!r} failed on series {series_id}, fold {folds[i]}, origin {stop - 1}: {error}") from error
                values[i, order] = found
        return series_id, np.arange(folds.start, folds.stop), values, y[stops[:, None] - 1 + leads - first]

    def table(found: list[tuple]) -> pd.DataFrame:
        """COLUMNS of some series' forecasts, a row for each."""
        names, (m, k) = np.array(list(models), object), (len(models), len(leads))
        folds = np.concatenate([f for _, f, _, _ in found])
        each = np.repeat(folds, m * k)
        origin = r.initial + each * r.step - 1
        lead = np.tile(leads, len(folds) * m)
        order = np.tile(np.repeat(np.arange(m), k), len(folds))
        ids = np.repeat(np.array([x for x, *_ in found], object), [v.size for _, _, v, _ in found])
        actual = np.concatenate([np.repeat(a[:, None, :], m, axis=1).ravel() for *_, a in found])
        return pd.DataFrame(dict(zip(COLUMNS, (ids, each, origin, lead, origin + lead, names[order], order, actual, np.concatenate([v.ravel() for _, _, v, _ in found])), strict=True)))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for series_id, y in zip(pdf["series_id"], pdf["y"], strict=True):
                if not (n := r.folds(len(y))):
                    raise ValueError(f"series {series_id} is too short for one fold")
                held.append(forecasts(series_id, np.asarray(y, float), 0, range(n)))
                size += held[-1][2].size
                if size > 100_000:
                    yield table(held)
                    held, size = [], 0
        if held:
            yield table(held)

    def stretch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        n, first = r.folds(int(pdf["n"].iloc[0])), int(pdf["chunk"].iloc[0]) * folds_per_task
        if not n:
            raise ValueError(f"series {pdf['series_id'].iloc[0]} is too short for one fold")
        return table([forecasts(pdf["series_id"].iloc[0], pdf["y"].to_numpy(float), int(pdf["t"].iloc[0]), range(first, min(n, first + folds_per_task)))])

    if folds_per_task is None:
        # a series is a row, so one call of Python serves many
        lines = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("cells"))
        return lines.select("series_id", F.col("cells.y").alias("y")).mapInPandas(whole, SCHEMA)
    sized = series.join(series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), "series_id")
    folds = F.expr(f"(n - {r.gap + r.horizon + r.initial}) div {r.step} + 1")
    chunks = F.expr(f"greatest(0L, ceil(folds / {folds_per_task}D) - 1)")
    # a row goes to the runs of folds whose first training position and last target enclose it
    span, reach = folds_per_task * r.step, r.gap + r.horizon
    low = F.expr(f"greatest(0L, ceil((t - {r.initial + reach - 1 + span - r.step}) / {span}D))")
    high = F.col("last") if r.window is None else F.least(F.col("last"), F.expr(f"floor((t - {r.initial - r.window}) / {span}D)"))
    dealt = sized.withColumn("folds", folds).withColumn("last", chunks).withColumn("low", low).withColumn("high", F.greatest(high, F.lit(0).cast("long")))
    dealt = dealt.where("low <= high").withColumn("chunk", F.explode(F.expr("sequence(cast(low as long), cast(high as long))"))).where("chunk <= last")
    return dealt.select("series_id", "t", "y", "n", "chunk").groupBy("series_id", "chunk").applyInPandas(stretch, SCHEMA)


def from_predictions(series: DataFrame, predictions: DataFrame, splits: DataFrame) -> DataFrame:
    """Saved forecasts as a backtest.

    predictions: series_id, fold, h (0, 1, ...), model, model_ord, forecast; splits: the columns of rolling_splits().  Splits must be
    ordered and in range with origin = train_stop - 1, rising origins, and one horizon and gap; every model must have each cell once
    and a finite forecast; anything else fails the job.
    """
    from pyspark.sql import Window

    by_fold = Window.partitionBy("series_id").orderBy("fold")
    n = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    checked = splits.join(n, "series_id", "left").withColumns({"before": F.lag("origin").over(by_fold), "h1": F.first(F.col("test_stop") - F.col("test_start")).over(by_fold), "g1": F.first(F.col("test_start") - F.col("train_stop")).over(by_fold)})
    fine = (
        (F.col("train_start") >= 0) & (F.col("train_start") < F.col("train_stop")) & (F.col("train_stop") <= F.col("test_start")) & (F.col("test_start") < F.col("test_stop")) & (F.col("test_stop") <= F.col("n"))
        & (F.col("origin") == F.col("train_stop") - 1) & (F.col("before").isNull() | (F.col("before") < F.col("origin"))) & (F.col("test_stop") - F.col("test_start") == F.col("h1")) & (F.col("test_start") - F.col("train_stop") == F.col("g1"))
    )
    checked = checked.select("series_id", "fold", "origin", F.when(F.coalesce(fine, F.lit(False)), F.col("test_start")).otherwise(F.raise_error(F.lit("invalid splits")).cast("long")).alias("test_start"), F.col("h1").alias("horizon"))
    models = predictions.select("series_id", "model", "model_ord").distinct()
    cells = checked.join(models, "series_id").withColumn("h", F.explode(F.expr("sequence(0L, horizon - 1)")))
    given = finite_values(predictions.groupBy("series_id", "fold", "h", "model").agg(F.when(F.count(F.lit(1)) == 1, F.max("forecast")).alias("forecast")), "forecast")
    whole = cells.join(given, ["series_id", "fold", "h", "model"], "full")
    exact = F.when(F.col("origin").isNotNull() & F.col("forecast").isNotNull(), F.col("forecast")).otherwise(F.raise_error(F.lit("forecasts must fill the splits exactly")).cast("double"))
    whole = whole.withColumn("forecast", exact).withColumn("target_index", F.col("test_start") + F.col("h"))
    actual = series.select("series_id", F.col("t").alias("target_index"), F.col("y").alias("actual"))
    return whole.join(actual, ["series_id", "target_index"]).select("series_id", "fold", "origin", (F.col("target_index") - F.col("origin")).alias("lead_time"), "target_index", "model", "model_ord", "actual", "forecast")


def rolling_ar1(series: DataFrame, leads: list[int], window: int | None = None, clip: float = 0.99) -> DataFrame:
    """AR(1) fitted at every origin by running sums, its slope clipped, and its closed-form forecasts of several leads.

    (series_id, origin, lead_time, target_index, slope, intercept, forecast, actual); the first origin has three observations, a
    constant history repeats its value, and targets beyond the series are left out.
    """
    from pyspark.sql import Window

    frame = ordered().rowsBetween(Window.unboundedPreceding if window is None else 2 - window, 0)
    pairs = series.withColumns({"x": F.lag("y").over(ordered()), **{f"y{lead}": F.lead("y", lead).over(ordered()) for lead in leads}})
    sums = {"n": F.count("x"), "sx": F.sum("x"), "sy": F.sum(F.when(F.col("x").isNotNull(), F.col("y"))), "sxx": F.sum(F.col("x") * F.col("x")), "sxy": F.sum(F.col("x") * F.col("y"))}
    fitted = pairs.withColumns({k: v.over(frame) for k, v in sums.items()}).where("n >= 2")
    spread, common = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    slope = F.when(spread > 0, F.greatest(F.lit(-clip), F.least(F.lit(clip), common / spread))).otherwise(0.0)
    fitted = fitted.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    power = lambda lead: F.pow("slope", F.lit(float(lead)))
    cells = F.array(*(F.struct(F.lit(lead).cast("long").alias("lead_time"), (F.col("intercept") * (1.0 - power(lead)) / (1.0 - F.col("slope")) + power(lead) * F.col("y")).alias("forecast"), F.col(f"y{lead}").alias("actual")) for lead in leads))
    out = fitted.select("series_id", F.col("t").alias("origin"), "slope", "intercept", F.explode(cells).alias("c")).where("c.actual is not null")
    return out.select("series_id", "origin", "c.lead_time", (F.col("origin") + F.col("c.lead_time")).alias("target_index"), "slope", "intercept", "c.forecast", "c.actual")
