"""The random stream and the distributions of the checks in SQL, and what the operators promise beside them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from augurline.functions.special import normal_sf, t_ppf, t_sf
from augurline.operators import bootstrap, conformal, evaluate
from augurline.operators.backtest import backtest
from augurline.operators.forecasters import Drift, Naive
from augurline.operators.splits import Rolling
from augurline.plans import catalog, oracle

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize(("seed", "n", "block", "b"), [(0, 9, 1.0, 4), (7, 23, 4.5, 9), (2**40, 30, 30.0, 3)])
def test_stream_in_sql_equals_the_operators_draws(seed, n, block, b):
    rows = duckdb.connect().execute(f"WITH RECURSIVE {oracle.stream_sql(seed, b, str(n), str(block))} SELECT idx FROM draws ORDER BY b, pos").fetchall()
    draws = bootstrap.draw_indices(n, block, seed, 0, b)
    assert [r[0] for r in rows] == draws.ravel().tolist()
    assert np.array_equal(bootstrap.draw_indices(n, block, seed, 1, b), draws[1:])


def test_tails_in_sql():
    c = duckdb.connect()
    for z in (-4.0, -0.3, 0.0, 1.7, 5.5):
        assert c.execute(f"SELECT {oracle.normal_tail(f'({z}e0)')}, {oracle.student_tail(f'({z}e0)', '40')}").fetchone() == pytest.approx((normal_sf(z), t_sf(z, 40)), abs=1e-12)
    assert c.execute(f"WITH {oracle.student_width('0.025e0', '57')} SELECT x FROM width").fetchone()[0] == pytest.approx(t_ppf(0.975, 57), abs=1e-10)


@pytest.mark.parametrize("name", ["bootstrap_family", "audit_fixed", "test_returns_resampled", "mean_pvalues", "multistep_intervals", "multistep_summary"])
def test_flagship_queries_equal_sql(spark, sf, name):
    c = duckdb.connect()
    for table in ("orders", "events"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = catalog.queries()[name](spark, sf).toPandas(), c.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = [x for x in ("series_id", "lead_time", "origin", "method", "col", "n_columns") if x in got]
    got, want = (x.sort_values(order).reset_index(drop=True) for x in (got, want))
    for column in got:
        if got[column].dtype == float:
            assert got[column].to_numpy() == pytest.approx(want[column].to_numpy(float), abs=2e-9, nan_ok=True), column
        else:
            assert got[column].tolist() == want[column].tolist(), column


def test_folds_with_other_leads_fail(spark, sf):
    test = catalog.group_test(spark, sf)
    broken = test.where("not (series_id = '1-URGENT' and fold = 3 and lead_time = 4)")
    with pytest.raises(Exception, match="same leads"):
        evaluate.evaluate(broken).collect()
    assert evaluate.evaluate(test).count() > 0


def test_comparison_of_series_of_unequal_length(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, float(v)) for s, n in (("a", 60), ("b", 90), ("c", 60)) for t, v in enumerate(rng.standard_normal(n).cumsum())]
    series = spark.createDataFrame(rows, "series_id string, t long, y double")
    test = backtest(series, {"naive": Naive(), "drift": Drift()}, Rolling(20, 1, 2, 2))
    whole = {r["panel_id"]: r for r in evaluate.compare_forecasts(test, "naive", 3, n_resamples=49).collect()}
    for s in "abc":
        alone = evaluate.compare_forecasts(test.where(F.col("series_id") == s), "naive", 3, n_resamples=49).first()
        assert alone == whole[s]
    assert whole["a"]["lags"] >= 1  # three steps ahead every two steps: forecasts overlap


def test_coverage_bound_equals_the_tracker(spark, sf):
    rng = np.random.default_rng(5)
    y = rng.standard_normal(80).cumsum()
    series = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(y)], "series_id string, t long, y double")
    points = series.selectExpr("series_id", "t as origin", "explode(array(1L, 3L)) as lead_time", "y as predicted")
    for lanes in ("pooled", "interlaced"):
        rules = {"step": 0.2, "decay": 0.4, "lanes": lanes}
        rows = conformal.multistep_intervals(series, points, (1, 3), rules)
        tracker = conformal.MultiStepConformal((1, 3), **rules)
        for t, v in enumerate(y):
            tracker.observe(t, float(v))
            tracker.predict([float(v)] * 2)
        want = {r["lead_time"]: r["coverage_bound"] for r in tracker.summary()}
        got = {r["lead_time"]: r["coverage_bound"] for r in conformal.interval_summary(rows, 0.1, rules).collect()}
        assert got == pytest.approx(want)


def test_tracker_goes_on_from_a_snapshot():
    import json

    rng = np.random.default_rng(6)
    rules = {"step": 0.1, "decay": 0.3, "scales": (1.0, 2.0), "scale_mode": "blended", "scale_decay": 0.9, "share_weights": (0.0, 0.5), "lanes": "interlaced"}
    tracker = conformal.MultiStepConformal((1, 4), **rules)
    for t, y in enumerate(rng.standard_normal(60).cumsum()):
        if t == 30:
            other = conformal.MultiStepConformal.from_dict(json.loads(json.dumps(tracker.to_dict())))
        seen = tracker.observe(t, float(y)), tracker.predict([float(y)] * 2)
        if t >= 30:
            assert (other.observe(t, float(y)), other.predict([float(y)] * 2)) == seen
    assert other.summary() == tracker.summary() and other.lane_state(4, 7) == tracker.lane_state(4, 7)


def test_arrays_and_factor_panels(spark):
    from augurline.operators import hac, simulate

    x = simulate.factor_panel(4000, 3, phi=0.1, factor_phi=0.9, share=0.5, seed=4)
    panel = hac.panel_of_array(spark, x)
    fitted = hac.fit_equicorrelated(panel).first()
    assert fitted["rho"] == pytest.approx(0.5, abs=0.15) and fitted["phi"] == pytest.approx(0.5, abs=0.1)
    assert [r["name"] for r in panel.where("t = 0").orderBy("col").collect()] == ["strategy_1", "strategy_2", "strategy_3"]
    with pytest.raises(ValueError):
        hac.panel_of_array(spark, x, ["a"])
