"""Splits, forecasters, backtests, scores: hand-written cases and plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from augurline.functions import losses
from augurline.operators import evaluate
from augurline.operators.backtest import backtest, from_predictions, rolling_ar1, series_of
from augurline.operators.forecasters import Autoregression, Differenced, Drift, Naive, SeasonalNaive, Windowed
from augurline.operators.splits import Rolling, rolling_splits


def frame(spark, series, name="a"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(series)], "series_id string, t long, y double")


@pytest.mark.parametrize(
    ("n", "rolling", "want"),
    [
        (12, Rolling(4, 3, 2, 1), [(0, 4, 5, 8, 3), (0, 6, 7, 10, 5), (0, 8, 9, 12, 7)]),
        (12, Rolling(4, 3, 2, 1, 3), [(1, 4, 5, 8, 3), (3, 6, 7, 10, 5), (5, 8, 9, 12, 7)]),
        (11, Rolling(4, 3, 2, 1, 5), [(0, 4, 5, 8, 3), (1, 6, 7, 10, 5)]),
    ],
)
def test_splits(spark, n, rolling, want):
    assert rolling.rows(n) == want
    got = rolling_splits(spark.createDataFrame([("a", n)], "series_id string, n long"), rolling).orderBy("fold").collect()
    assert [tuple(r)[2:] for r in got] == want and rolling.folds(n) == len(want)


def test_splits_reject_short_series_and_bad_parameters(spark):
    with pytest.raises(Exception, match="too short"):
        rolling_splits(spark.createDataFrame([("a", 3)], "series_id string, n long"), Rolling(4)).collect()
    for bad in ({"initial": 0}, {"initial": 2, "gap": -1}, {"initial": True}, {"initial": 2, "window": 0}):
        with pytest.raises(ValueError):
            Rolling(**bad)


def test_forecasters():
    leads = np.array([1, 3, 6])
    assert Drift()(np.array([1.0, 3, 4]), leads).tolist() == [5.5, 8.5, 13]
    assert SeasonalNaive(3)(np.array([2.0, 4, 8, 16, 32]), np.array([1, 2, 3, 4, 6, 7])).tolist() == [8, 16, 32, 8, 32, 8]
    assert Autoregression(1)(np.array([0, 2, 3, 3.5, 3.75, 3.875]), np.array([1, 2, 4])) == pytest.approx([3.9375, 3.96875, 3.9921875])
    assert Autoregression(4)(np.arange(20.0), np.array([1, 2, 10])) == pytest.approx([20, 21, 29])
    assert Autoregression(2)(np.full(7, 3.25), np.array([1, 1000])).tolist() == [3.25, 3.25]
    steps = lambda train, at: at.astype(float)
    assert Differenced(steps, 3)(np.array([2.0, 5, 11, 4, 10, 20]), np.array([8, 1, 4, 8])).tolist() == [25, 5, 9, 25]
    assert Differenced(Naive())(np.array([1.0, 3, 5, 7, 9]), np.array([3, 1, 6])).tolist() == [15, 11, 21]
    with pytest.raises(ValueError):
        Autoregression(3)(np.arange(5.0), leads)
    big = np.array([1e300, 1.5e300, 1.25e300, 1.375e300, 1.3125e300, 1.34375e300])
    assert Autoregression(1)(big, np.array([1]))[0] == pytest.approx(1.328125e300)


def test_closed_forms_equal_callbacks_in_any_chunks(spark):
    rng = np.random.default_rng(1)
    series = frame(spark, rng.normal(size=70)).union(frame(spark, rng.normal(size=41), "b")).repartition(3)
    models = {"naive": Naive(), "seasonal": SeasonalNaive(4), "drift": Drift()}
    for rolling in (Rolling(10, 2, 3, 1), Rolling(10, 3, 1, 0, 6), Rolling(8, 1, 4, 2, 12)):
        rows = lambda df: sorted((*(tuple(r)[:7]), round(r["actual"], 9), round(r["forecast"], 9)) for r in df.collect())
        closed = rows(backtest(series, models, rolling))
        calls = {k: (lambda m: lambda y, leads: m(y, leads))(m) for k, m in models.items()}
        for per in (None, 1, 4):
            assert rows(backtest(series, calls, rolling, folds_per_task=per)) == closed


def test_drift_and_naive_backtest(spark):
    test = backtest(frame(spark, range(12)), {"drift": Drift(), "naive": Naive()}, Rolling(4, 3, 2, 1)).collect()
    assert {r["lead_time"] for r in test} == {2, 3, 4}
    assert all(r["forecast"] == pytest.approx(r["actual"]) for r in test if r["model"] == "drift")
    assert sorted({r["forecast"] for r in test if r["model"] == "naive"}) == [3, 5, 7]


def test_failing_callbacks_say_where(spark):
    def broken(y, leads):
        raise KeyError("x") if len(y) > 5 else ValueError("y")

    with pytest.raises(Exception, match="model 'm' failed on series a, fold 0, origin 3"):
        backtest(frame(spark, range(12)), {"m": broken}, Rolling(4)).collect()
    with pytest.raises(Exception, match="one finite value"):
        backtest(frame(spark, range(12)), {"m": lambda y, leads: y}, Rolling(4)).collect()


def test_imported_predictions(spark):
    series = frame(spark, range(1, 9))
    rolling = Rolling(3, 2, 2, 1, 3)
    splits = rolling_splits(spark.createDataFrame([("a", 8)], "series_id string, n long"), rolling)
    rows = []
    for fold, (_, stop, start, end, _) in enumerate(rolling.rows(8)):
        for h in range(end - start):
            rows += [("a", fold, h, "naive", 0, float(stop)), ("a", fold, h, "linear", 1, float(start + h + 1))]
    saved = spark.createDataFrame(rows, "series_id string, fold int, h long, model string, model_ord int, forecast double")
    scores = {(r["lead_time"], r["model"]): r["mean_loss"] for r in evaluate.evaluate(from_predictions(series, saved, splits)).collect()}
    assert scores == {(2, "naive"): 4, (2, "linear"): 0, (3, "naive"): 9, (3, "linear"): 0}
    for bad in (saved.limit(len(rows) - 1), saved.union(saved.limit(1)), saved.withColumn("fold", F.col("fold") + 1), saved.withColumn("forecast", F.lit(float("nan")))):
        with pytest.raises(Exception, match="exactly|finite"):
            from_predictions(series, bad, splits).collect()
    with pytest.raises(Exception, match="invalid splits"):
        from_predictions(series, saved, splits.withColumn("origin", F.col("origin") - 1)).collect()


def test_losses(spark):
    one = spark.createDataFrame([(2.0, 0.0), (-2.0, 0.0)], "a double, p double")
    value = lambda *a: [r[0] for r in one.select(losses.forecast_loss(F.col("a"), F.col("p"), *a)).collect()]
    assert value("pinball", 0.25) == [0.5, 1.5] and value("squared") == [4, 4] and value("absolute") == [2, 2]
    for bad in (("pinball",), ("squared", 0.5), ("other",), ("pinball", 1.0)):
        with pytest.raises(ValueError):
            value(*bad)
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(1e200, -1e200)], "a double, p double").select(losses.forecast_loss(F.col("a"), F.col("p"))).collect()
    ys = spark.createDataFrame([(float(y),) for y in range(-1, 4)], "y double")
    assert [r[0] for r in ys.select(losses.interval_score(F.col("y"), F.lit(0.0), F.lit(2.0), 0.5)).collect()] == [6, 2, 2, 2, 6]
    assert ys.select(losses.interval_score(F.col("y"), F.lit(float("-inf")), F.lit(2.0), 0.5)).first()[0] == math.inf
    with pytest.raises(Exception, match="ordered"):
        ys.select(losses.interval_score(F.col("y"), F.lit(3.0), F.lit(2.0), 0.5)).collect()
    s = spark.createDataFrame([(3.0, 4.0, 0.5), (1.0, 2.0, 0.0), (1.0, 2.0, 1.0)], "own double, shared double, w double")
    assert [r[0] for r in s.select(losses.blend(F.col("own"), F.col("shared"), F.col("w"))).collect()] == pytest.approx([3.5, 1, 2])
    assert s.select(losses.bounded_score(F.lit(-3.0), F.lit(1.0)), losses.ewma_scale(F.lit(1.0), F.lit(2.0), 0.5, F.lit(0.1)), losses.learning_rate(F.lit(0.5), F.lit(4), 0.5), losses.log_sum_exp(F.array(F.lit(float("-inf")), F.lit(0.0), F.lit(0.0)))).first() == pytest.approx((0.75, math.sqrt(2.5), 0.25, math.log(2)))


def test_selection_takes_the_first_of_ties(spark):
    series = frame(spark, [1, -1, 2, 0, 3, 4, -2, 1, 5, 6, 7])
    models = {"b": Windowed(Naive(), 3), "a": Naive(), "mean": lambda y, leads: np.full(len(leads), y.mean()) + 0.3 * leads}
    got = {r["model"]: r for r in evaluate.select_forecaster(series, 5, models, loss="absolute").collect()}
    assert [m for m, r in got.items() if r["selected"]] == ["b"] and got["a"]["mean_loss"] == got["b"]["mean_loss"]
    y = [1, -1, 2, 0, 3, 4, -2, 1, 5, 6, 7]
    assert got["mean"]["mean_loss"] == pytest.approx(np.mean([abs(y[i] - np.mean(y[:i]) - 0.3) for i in range(5, 11)]))


def test_overlap_defaults():
    assert evaluate.overlap_defaults(62, 17, 2) == (8, 9, False)
    assert evaluate.overlap_defaults(20, 41, 1) == (18, 20, True)


def test_improvements_need_a_regular_panel(spark):
    test = backtest(frame(spark, [1, 5, 2, 8, 3, 9, 4, 7, 5, 6, 2, 4]), {"naive": Naive(), "drift": Drift()}, Rolling(3))
    assert evaluate.improvements(test, "naive", 1).count() == 9
    with pytest.raises(Exception, match="regularly"):
        evaluate.improvements(test.where("fold <> 4"), "naive", 1).collect()
    with pytest.raises(Exception, match="constant loss"):
        evaluate.improvements(test.withColumn("forecast", F.col("actual")), "naive", 1).collect()


def test_rolling_ar1_against_least_squares(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=40).cumsum()
    for r in rolling_ar1(frame(spark, y), [1, 3], 12).collect():
        own = y[max(0, r["origin"] - 11) : r["origin"] + 1]
        slope, intercept = np.polyfit(own[:-1], own[1:], 1)
        slope = min(0.99, max(-0.99, slope))
        intercept = own[1:].mean() - slope * own[:-1].mean()
        value = y[r["origin"]]
        for _ in range(r["lead_time"]):
            value = intercept + slope * value
        assert r["forecast"] == pytest.approx(value) and r["actual"] == y[r["origin"] + r["lead_time"]]


def test_series_positions_ignore_calendar_gaps(spark):
    df = spark.createDataFrame([("k", "2020-01-05", 2.0), ("k", "2020-01-01", 1.0), ("j", "2020-01-09", 3.0)], "k string, d string, v double")
    assert sorted(tuple(r) for r in series_of(df, "k", ["d"], "v").collect()) == [("j", 0, 3.0), ("k", 0, 1.0), ("k", 1, 2.0)]
    with pytest.raises(Exception, match="finite"):
        series_of(df.withColumn("v", F.lit(None).cast("double")), "k", ["d"], "v").collect()
