"""Registered queries of the forecast operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurline.functions.losses import interval_kind, interval_radius, interval_score
from augurline.operators import bootstrap, certified, conformal, evaluate, hac, sequential, simulate
from augurline.operators.backtest import backtest, from_predictions, rolling_ar1
from augurline.operators.forecasters import Autoregression, Differenced, Drift, Naive, SeasonalNaive, Windowed
from augurline.operators.splits import Rolling, rolling_splits
from augurline.plans import oracle
from augurline.sources import testdata

Query = Callable[[SparkSession, str], DataFrame]
CLOSED = {"naive": Naive(), "seasonal": SeasonalNaive(7), "drift": Drift()}
WEEKLY = {"naive": Naive(), "seasonal": SeasonalNaive(4)}
FLAG = Rolling(365, 1, 1, 0, 28)
MULTI = Rolling(100, 3, 5, 2)
PLACES = 9


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of places, as engines differ in the last bits of sums."""
    return df.select(*((F.round(F.col(c), PLACES).alias(c)) if kind == "double" else F.col(c) for c, kind in df.dtypes))


_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _found[f.__name__] = (lambda spark, sf_dir: rounded(f(spark, sf_dir)), sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _found.items() if sql}


def r(expression: str, name: str) -> str:
    return f"round({expression}, {PLACES}) AS {name}"


DAILY = "s AS MATERIALIZED (SELECT 'all' AS series_id, row_number() OVER (ORDER BY o_orderdate) - 1 AS t, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY o_orderdate)"
BY_PRIORITY = "s AS MATERIALIZED (SELECT o_orderpriority AS series_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) - 1 AS t, sum(o_totalprice) / 1e6 AS y FROM orders GROUP BY o_orderpriority, o_orderdate)"
WEEKS = """c AS (SELECT date_trunc('week', o_orderdate) AS w, o_orderpriority AS name, sum(o_totalprice) / 1e6 AS value FROM orders GROUP BY 1, 2),
 wk AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS t FROM (SELECT DISTINCT w FROM c)), nm AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS col FROM (SELECT DISTINCT name FROM c)),
 raw AS MATERIALIZED (SELECT 'weekly' AS panel_id, wk.t, nm.col, nm.name, coalesce(c.value, 0e0) AS value FROM wk CROSS JOIN nm LEFT JOIN c ON c.w = wk.w AND c.name = nm.name)"""
PANEL = WEEKS + ",\n p AS MATERIALIZED (SELECT panel_id, t, col, name, value - avg(value) OVER (PARTITION BY t) AS value FROM raw)"


def closed_sql(source: str, rolling: Rolling, models: dict) -> str:
    """Forecast rows b of the closed-form models."""
    g = rolling
    leads = ", ".join(f"({v})" for v in g.leads)
    start = "0" if g.window is None else f"greatest(0, f.train_stop - {g.window})"
    period = next((m.period for m in models.values() if isinstance(m, SeasonalNaive)), 1)
    forms = {"naive": "z", "drift": "z + lead_time * (z - a) / (train_stop - train_start - 1)", "seasonal": "q"}
    parts = [f"SELECT series_id, fold, origin, lead_time, origin + lead_time AS target_index, '{name}' AS model, {order} AS model_ord, x AS actual, {forms[name]} AS forecast FROM g" for order, name in enumerate(models)]
    return f"""{source}, n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1),
 f0 AS (SELECT series_id, k AS fold, {g.initial} + k * {g.step} AS train_stop FROM (SELECT series_id, unnest(range((n - {g.gap + g.horizon + g.initial}) // {g.step} + 1)) AS k FROM n)),
 f AS MATERIALIZED (SELECT f.series_id, f.fold, {start} AS train_start, f.train_stop, f.train_stop - 1 AS origin, lead_time, f.train_stop - 1 + lead_time AS tx, f.train_stop - {period} + (lead_time - 1) % {period} AS tq FROM f0 f CROSS JOIN (SELECT CAST(v AS BIGINT) AS lead_time FROM (VALUES {leads}) AS q(v))),
 g AS MATERIALIZED (SELECT f.*, x.y AS x, z.y AS z, a.y AS a, q.y AS q FROM f JOIN s x ON x.series_id = f.series_id AND x.t = f.tx JOIN s z ON z.series_id = f.series_id AND z.t = f.origin JOIN s a ON a.series_id = f.series_id AND a.t = f.train_start JOIN s q ON q.series_id = f.series_id AND q.t = f.tq),
 b AS MATERIALIZED ({" UNION ALL ".join(parts)})"""


BACK = "WITH " + closed_sql(DAILY, FLAG, CLOSED)
BACK5 = "WITH " + closed_sql(BY_PRIORITY, MULTI, WEEKLY)
LOSSES = {"squared": "(actual - forecast) * (actual - forecast)", "absolute": "abs(actual - forecast)", "pinball": "greatest(0.25e0 * (actual - forecast), -0.75e0 * (actual - forecast))"}


def flag_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(testdata.daily_revenue(spark, sf_dir), CLOSED, FLAG)


def group_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest(testdata.daily_revenue(spark, sf_dir, "o_orderpriority"), WEEKLY, MULTI)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue, rolling origins, three closed forms: mean absolute loss by lead and model."""
    return evaluate.evaluate(flag_test(spark, sf_dir), "absolute")


def evaluated_sql(back: str, loss: str) -> str:
    return f"{back} SELECT series_id, lead_time, model, CAST(model_ord AS INTEGER) AS model_ord, count(*) AS n_origins, {r(f'avg({LOSSES[loss]})', 'mean_loss')} FROM b GROUP BY 1, 2, 3, 4"


@query("WITH " + BY_PRIORITY + ", n AS (SELECT series_id, count(*) AS n FROM s GROUP BY 1) SELECT series_id, CAST(k AS INTEGER) AS fold, greatest(0, 100 + 5 * k - 60) AS train_start, 100 + 5 * k AS train_stop, 102 + 5 * k AS test_start, 105 + 5 * k AS test_stop, 99 + 5 * k AS origin FROM (SELECT series_id, unnest(range((n - 105) // 5 + 1)) AS k FROM n)")
def splits(spark, sf_dir):
    lengths = testdata.daily_revenue(spark, sf_dir, "o_orderpriority").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return rolling_splits(lengths, Rolling(100, 3, 5, 2, 60))


@query(BACK + f" SELECT series_id, CAST(fold AS INTEGER) AS fold, origin, lead_time, target_index, model, CAST(model_ord AS INTEGER) AS model_ord, {r('actual', 'actual')}, {r('forecast', 'forecast')} FROM b")
def backtest_closed(spark, sf_dir):
    return flag_test(spark, sf_dir)


@query(BACK5 + f" SELECT series_id, CAST(fold AS INTEGER) AS fold, origin, lead_time, target_index, model, CAST(model_ord AS INTEGER) AS model_ord, {r('actual', 'actual')}, {r('forecast', 'forecast')} FROM b")
def backtest_callbacks(spark, sf_dir):
    """The same forecasters as callbacks on arrays, in runs of 40 folds."""
    models = {k: Windowed(m, 10_000) for k, m in WEEKLY.items()}
    return backtest(testdata.daily_revenue(spark, sf_dir, "o_orderpriority"), models, MULTI, folds_per_task=40)


@query(evaluated_sql(BACK, "absolute"))
def evaluate_absolute(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(evaluated_sql(BACK5, "squared"))
def evaluate_squared(spark, sf_dir):
    return evaluate.evaluate(group_test(spark, sf_dir), "squared")


@query(evaluated_sql(BACK5, "pinball"))
def evaluate_pinball(spark, sf_dir):
    return evaluate.evaluate(group_test(spark, sf_dir), "pinball", 0.25)


@query(f"{BACK5} SELECT series_id, lead_time, model, CAST(model_ord AS INTEGER) AS model_ord, {r('avg(abs(actual - forecast))', 'mae')}, {r('sqrt(avg((actual - forecast) * (actual - forecast)))', 'rmse')} FROM b GROUP BY 1, 2, 3, 4")
def accuracy(spark, sf_dir):
    return evaluate.accuracy(group_test(spark, sf_dir))


@query("WITH " + BY_PRIORITY + f" SELECT a.series_id, {r('avg(abs(a.y - b.y))', 'scale')} FROM s a JOIN s b ON a.series_id = b.series_id AND b.t = a.t - 7 WHERE a.t < 200 GROUP BY 1")
def mase_scale(spark, sf_dir):
    return evaluate.mase_scale(testdata.daily_revenue(spark, sf_dir, "o_orderpriority"), 200, 7)


@query(f"WITH {closed_sql(BY_PRIORITY, Rolling(150, 1, 1, 1), WEEKLY)}, e AS (SELECT series_id, lead_time, model, model_ord, count(*) AS n_origins, avg(abs(actual - forecast)) AS m FROM b GROUP BY 1, 2, 3, 4) SELECT series_id, lead_time, model, CAST(model_ord AS INTEGER) AS model_ord, n_origins, {r('m', 'mean_loss')}, row_number() OVER (PARTITION BY series_id ORDER BY m, model_ord) = 1 AS selected FROM e")
def select_forecaster(spark, sf_dir):
    return evaluate.select_forecaster(testdata.daily_revenue(spark, sf_dir, "o_orderpriority"), 150, WEEKLY, lead_time=2, loss="absolute")


@query(f"{BACK}, m AS (SELECT fold, max(CASE WHEN model = 'naive' THEN abs(actual - forecast) END) AS base FROM b GROUP BY 1) SELECT b.series_id AS panel_id, b.fold AS t, CAST(model_ord - 1 AS INTEGER) AS col, model AS name, {r('base - abs(actual - forecast)', 'value')} FROM b JOIN m USING (fold) WHERE model <> 'naive'")
def loss_improvements(spark, sf_dir):
    return evaluate.improvements(flag_test(spark, sf_dir), "naive", 1, "absolute")


def family_columns(names: dict[str, str] | None = None, prefix: str = "") -> str:
    """The test's columns, doubles rounded, some of them under other names."""
    names = names or {}
    return ", ".join([*(r(prefix + c, names.get(c, c)) for c in oracle.FAMILY_DOUBLES), *(f"{prefix}{c} AS {names.get(c, c)}" for c in oracle.FAMILY_OTHERS)])


def with_notes(found: DataFrame) -> DataFrame:
    return found.withColumn("warnings", F.array_join("warnings", "; "))


@query(
    BACK.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", m0 AS (SELECT fold, max(CASE WHEN model = 'naive' THEN abs(actual - forecast) END) AS base FROM b GROUP BY 1), p AS MATERIALIZED (SELECT b.series_id AS panel_id, b.fold AS t, model_ord - 1 AS col, model AS name, base - abs(actual - forecast) AS value FROM b JOIN m0 USING (fold) WHERE model <> 'naive'),
 {oracle.family_sql(199, resampled=True)}, lo AS (SELECT model, avg(abs(actual - forecast)) AS loss FROM b GROUP BY 1)
 SELECT {family_columns({'name': 'model', 'mean': 'mean_improvement'}, 'f.')}, {r('own.loss', 'mean_loss')}, {r('bas.loss', 'baseline_loss')}, {r('CASE WHEN bas.loss <> 0 THEN f.mean / bas.loss END', 'relative_improvement')} FROM family f JOIN lo own ON own.model = f.name CROSS JOIN (SELECT loss FROM lo WHERE model = 'naive') bas"""
)
def compare_forecasts(spark, sf_dir):
    return with_notes(evaluate.compare_forecasts(flag_test(spark, sf_dir), "naive", 1, loss="absolute", n_resamples=199))


@query(BACK5 + f" SELECT series_id, CAST(fold AS INTEGER) AS fold, origin, lead_time, target_index, model, CAST(model_ord AS INTEGER) AS model_ord, {r('actual', 'actual')}, {r('forecast', 'forecast')} FROM b")
def saved_predictions(spark, sf_dir):
    """Forecasts of a backtest saved without actuals, then imported against declared splits."""
    series = testdata.daily_revenue(spark, sf_dir, "o_orderpriority")
    saved = group_test(spark, sf_dir).select("series_id", "fold", (F.col("lead_time") - 3).alias("h"), "model", "model_ord", "forecast")
    lengths = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return from_predictions(series, saved, rolling_splits(lengths, MULTI))


@query("WITH " + DAILY + f""", q AS (SELECT a.t, a.y, b.y AS x FROM s a LEFT JOIN s b ON b.t = a.t - 1),
 g AS (SELECT t, y, count(x) OVER w AS n, sum(x) OVER w AS sx, sum(CASE WHEN x IS NOT NULL THEN y END) OVER w AS sy, sum(x * x) OVER w AS sxx, sum(x * y) OVER w AS sxy FROM q WINDOW w AS (ORDER BY t ROWS BETWEEN 58 PRECEDING AND CURRENT ROW)),
 h AS (SELECT *, CASE WHEN sxx - sx * sx / n > 0 THEN greatest(-0.99e0, least(0.99e0, (sxy - sx * sy / n) / (sxx - sx * sx / n))) ELSE 0e0 END AS slope FROM g WHERE n >= 2), i AS (SELECT *, (sy - slope * sx) / n AS intercept FROM h)
 SELECT 'all' AS series_id, i.t AS origin, lead_time, i.t + lead_time AS target_index, {r('slope', 'slope')}, {r('intercept', 'intercept')}, {r('intercept * (1 - pow(slope, lead_time)) / (1 - slope) + pow(slope, lead_time) * i.y', 'forecast')}, {r('s.y', 'actual')} FROM i CROSS JOIN (SELECT CAST(v AS BIGINT) AS lead_time FROM (VALUES (1), (6)) AS q(v)) JOIN s ON s.t = i.t + lead_time""")
def rolling_ar1_forecasts(spark, sf_dir):
    return rolling_ar1(testdata.daily_revenue(spark, sf_dir), [1, 6], 60)


@query()
def backtest_autoregressions(spark, sf_dir):
    models = {"ar3": Autoregression(3), "sparse": Autoregression((1, 7), 0.1), "differenced": Differenced(Autoregression(2), 7), "windowed": Windowed(Autoregression(2), 60)}
    return evaluate.evaluate(backtest(testdata.daily_revenue(spark, sf_dir, "o_orderpriority"), models, Rolling(180, 2, 20)))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.centred(testdata.priority_panel(spark, sf_dir))


GAMMAS = f"WITH {PANEL}, e AS MATERIALIZED (SELECT col, name, t, value, value - avg(value) OVER (PARTITION BY col) AS e, count(*) OVER (PARTITION BY col) AS n FROM p), k AS (SELECT unnest(range(5)) AS h), g AS (SELECT a.col, a.name, k.h, sum(a.e * b.e) / max(a.n) AS gamma FROM e a CROSS JOIN k JOIN e b ON a.col = b.col AND b.t = a.t - k.h GROUP BY 1, 2, 3), m AS (SELECT col, name, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM p GROUP BY 1, 2), v AS (SELECT col, sum(CASE WHEN h = 0 THEN gamma ELSE 2 * (1 - h / 5e0) * gamma END) AS lrv FROM g GROUP BY 1), x AS MATERIALIZED (SELECT m.*, v.lrv, sqrt(v.lrv / m.n) AS se FROM m JOIN v USING (col))"


@query(GAMMAS + f" SELECT 'weekly' AS panel_id, CAST(x.col AS INTEGER) AS col, x.name, n, {r('mean', 'mean')}, {r('sd', 'sd')}, {', '.join(r(f'max(CASE WHEN h = {h} THEN gamma END)', f'gamma{h}') for h in range(5))} FROM x JOIN g ON g.col = x.col GROUP BY 1, 2, 3, 4, mean, sd")
def autocovariances(spark, sf_dir):
    return hac.autocovariances(panel(spark, sf_dir), 4)


@query(GAMMAS + f" SELECT 'weekly' AS panel_id, CAST(col AS INTEGER) AS col, name, n, {r('mean', 'mean')}, {r('sd', 'sd')}, 4 AS lags, {r('lrv', 'lrv')} FROM x")
def long_run_variance(spark, sf_dir):
    return hac.long_run_variance(panel(spark, sf_dir), 4)


@query(GAMMAS.replace("range(5)", "range(CAST(least(floor(4 * pow((SELECT max(t) + 1 FROM p) / 100e0, 2 / 9e0)), 1e6) AS BIGINT) + 1)").replace("h / 5e0", "h / (floor(4 * pow(n / 100e0, 2 / 9e0)) + 1)").replace("v AS (SELECT col, sum(", "v AS (SELECT g.col, sum(").replace("FROM g GROUP BY 1), x", "FROM g JOIN m USING (col) GROUP BY 1), x") + f" SELECT 'weekly' AS panel_id, CAST(col AS INTEGER) AS col, name, n, {r('mean', 'mean')}, {r('sd', 'sd')}, CAST(floor(4 * pow(n / 100e0, 2 / 9e0)) AS INTEGER) AS lags, {r('lrv', 'lrv')} FROM x")
def long_run_variance_default(spark, sf_dir):
    return hac.long_run_variance(panel(spark, sf_dir))


@query(GAMMAS + f" SELECT 'weekly' AS panel_id, CAST(col AS INTEGER) AS col, name, n, {r('mean', 'mean')}, {r('se', 'standard_error')}, {r('mean / se', 'statistic')}, {r('mean - 1.959963984540054e0 * se', 'ci_low')}, {r('mean + 1.959963984540054e0 * se', 'ci_high')}, {r(oracle.normal_tail('(mean / se)'), 'pvalue')} FROM x")
def infer_mean_hac(spark, sf_dir):
    return hac.infer_mean(hac.checked_panel(panel(spark, sf_dir)), "hac", 4)


IID = f"WITH {PANEL}, q AS MATERIALIZED (SELECT CAST(col AS INTEGER) AS col, name, count(*) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS se FROM p GROUP BY 1, 2), {oracle.student_width('0.025e0', '(SELECT max(n) - 1 FROM q)')} SELECT 'weekly' AS panel_id, col, name, n, {r('mean', 'mean')}, {r('se', 'standard_error')}, {r('mean / se', 'statistic')}, {r('mean - x * se', 'ci_low')}, {r('mean + x * se', 'ci_high')}, {r(oracle.student_tail('(mean / se)', '(n - 1)'), 'pvalue')}"


@query(IID + " FROM q CROSS JOIN width")
def infer_mean_iid(spark, sf_dir):
    return hac.infer_mean(panel(spark, sf_dir), "iid")


@query(
    f"SELECT *, 'iid' AS method FROM ({IID} FROM q CROSS JOIN width) UNION ALL BY NAME SELECT *, 'hac' AS method FROM ("
    + GAMMAS.replace("range(5)", "range(CAST(floor(4 * pow((SELECT max(t) + 1 FROM p) / 100e0, 2 / 9e0)) AS BIGINT) + 1)").replace("h / 5e0", "h / (floor(4 * pow(n / 100e0, 2 / 9e0)) + 1)").replace("v AS (SELECT col, sum(", "v AS (SELECT g.col, sum(").replace("FROM g GROUP BY 1), x", "FROM g JOIN m USING (col) GROUP BY 1), x")
    + f" SELECT 'weekly' AS panel_id, CAST(col AS INTEGER) AS col, name, n, {r('mean', 'mean')}, {r('se', 'standard_error')}, {r('mean / se', 'statistic')}, {r('mean - 1.959963984540054e0 * se', 'ci_low')}, {r('mean + 1.959963984540054e0 * se', 'ci_high')}, {r(oracle.normal_tail('(mean / se)'), 'pvalue')} FROM x)"
)
def mean_pvalues(spark, sf_dir):
    p = panel(spark, sf_dir)
    return hac.infer_mean(p, "hac").withColumn("method", F.lit("hac")).unionByName(hac.infer_mean(p, "iid").withColumn("method", F.lit("iid")))


@query(f"WITH {PANEL} SELECT a.panel_id, a.t, CAST(a.col - CAST(a.col > b.col AS INTEGER) AS INTEGER) AS col, a.name, {r('a.value - b.value', 'value')} FROM p a JOIN p b ON a.t = b.t AND b.name = '3-MEDIUM' WHERE a.name <> '3-MEDIUM'")
def benchmark_subtraction(spark, sf_dir):
    return hac.subtract_benchmark(panel(spark, sf_dir), "3-MEDIUM")


@query(GAMMAS + f", f AS (SELECT g0.col, g1.gamma / g0.gamma AS phi FROM g g0 JOIN g g1 ON g0.col = g1.col AND g0.h = 0 AND g1.h = 1) SELECT 'weekly' AS panel_id, CAST(x.col AS INTEGER) AS col, name, n, {r('mean', 'mean')}, {r('sd', 'sd')}, 4 AS lags, {r('lrv', 'lrv')}, {r('phi', 'phi')}, {r('((1 + phi) / (1 - phi)) / (1 + 2 * (0.8e0 * phi + 0.6e0 * phi ** 2 + 0.4e0 * phi ** 3 + 0.2e0 * phi ** 4))', 'factor')}, {r('lrv * ((1 + phi) / (1 - phi)) / (1 + 2 * (0.8e0 * phi + 0.6e0 * phi ** 2 + 0.4e0 * phi ** 3 + 0.2e0 * phi ** 4))', 'variance')} FROM x JOIN f USING (col)")
def tail_variance(spark, sf_dir):
    t = hac.tail_variance(panel(spark, sf_dir), 4)
    return t.select("panel_id", "col", "name", "n", "mean", "sd", "lags", "lrv", "phi", "factor", "variance")


@query(GAMMAS + f", f AS (SELECT avg(g1.gamma / g0.gamma) AS phi FROM g g0 JOIN g g1 ON g0.col = g1.col AND g0.h = 0 AND g1.h = 1), cr AS (SELECT avg(corr) AS rho FROM (SELECT a.col, b.col, corr(a.value, b.value) AS corr FROM p a JOIN p b ON a.t = b.t AND a.col <> b.col GROUP BY 1, 2)) SELECT 'weekly' AS panel_id, {r('phi', 'phi')}, {r('greatest(0e0, least(1e0, rho))', 'rho')} FROM f CROSS JOIN cr")
def fit_equicorrelated(spark, sf_dir):
    return hac.fit_equicorrelated(panel(spark, sf_dir))


@query(f"WITH {PANEL}, w AS (SELECT col, name, CASE WHEN t = 0 THEN sqrt(0.91e0) ELSE 0.7e0 END AS x, CASE WHEN t = 0 THEN sqrt(0.91e0) * value ELSE value - 0.3e0 * lag(value) OVER (PARTITION BY col ORDER BY t) END AS y FROM p), g AS (SELECT col, name, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM w GROUP BY 1, 2) SELECT 'weekly' AS panel_id, CAST(col AS INTEGER) AS col, name, n, {r('xy / xx', 'mean')}, {r('(xy / xx) / sqrt((yy - xy * xy / xx) / (n - 1) / xx)', 'statistic')}, {r(oracle.student_tail('((xy / xx) / sqrt((yy - xy * xy / xx) / (n - 1) / xx))', '(n - 1)'), 'pvalue')} FROM g")
def known_phi_t(spark, sf_dir):
    return hac.known_phi_t(panel(spark, sf_dir), 0.3)


STREAM = f"WITH RECURSIVE {PANEL}, {oracle.stream_sql(5, 60, '(SELECT count(*) FROM p WHERE col = 0)', '12')}"


@query(STREAM + " SELECT b, pos, idx FROM draws")
def bootstrap_indices(spark, sf_dir):
    """The rows that each draw takes, as the operators make them."""
    n = F.count_if(F.col("col") == 0).alias("n")
    return bootstrap.index_table(panel(spark, sf_dir).agg(n), 60, 12, 5)


@query(STREAM + f", e AS (SELECT col, name, t, value - avg(value) OVER (PARTITION BY col) AS e FROM p) SELECT 'weekly' AS panel_id, b, CAST(col AS INTEGER) AS col, {r('1e3 * avg(e)', 'mean')} FROM draws JOIN e ON e.t = draws.idx GROUP BY 1, 2, 3")
def bootstrap_means(spark, sf_dir):
    """Centred means of each draw, in units of a thousandth: the draws' statistics times the standard errors."""
    p = panel(spark, sf_dir)
    se = hac.long_run_variance(p, 4).select("col", F.sqrt(F.col("lrv") / F.col("n")).alias("se"))
    return bootstrap.draws(p, n_resamples=60, block_length=12, lags=4, seed=5).join(se, "col").select("panel_id", "b", "col", (1000 * F.col("statistic") * F.col("se")).alias("mean"))


@query(f"WITH RECURSIVE {PANEL}, {oracle.family_sql(60, seed=5, block='12', lags='4')} SELECT 'weekly' AS panel_id, k AS n_columns, {r('(1 + sum(CAST(top >= (SELECT max(stat) FROM o WHERE col < k) AS INTEGER))) / 61e0', 'global_pvalue')} FROM (SELECT b, k, max(s) AS top FROM st JOIN (SELECT unnest(range(1, 6)) AS k) ON col < k GROUP BY 1, 2) GROUP BY 1, 2")
def bootstrap_family(spark, sf_dir):
    """Nested families: the global p-value of the first column, the first two, and so on, from one set of draws."""
    return bootstrap.nested_families(panel(spark, sf_dir), n_resamples=60, block_length=12, lags=4, seed=5)


@query(f"WITH {PANEL}, e AS (SELECT col, name, t, value - avg(value) OVER (PARTITION BY col) AS e, count(*) OVER (PARTITION BY col) AS n FROM p), cv AS (SELECT a.col, a.name, a.n, (b.t - a.t + a.n) % a.n AS h, sum(a.e * b.e) / a.n AS c FROM e a JOIN e b ON a.col = b.col GROUP BY 1, 2, 3, 4) SELECT 'weekly' AS panel_id, CAST(col AS INTEGER) AS col, name, {r('1000 * sum(CASE WHEN h = 0 THEN c ELSE 2 * (1 - h / CAST(n AS DOUBLE)) * pow(1 - 1 / 12e0, h) * c END) / max(n)', 'variance')} FROM cv GROUP BY 1, 2, 3")
def bootstrap_mean_variance(spark, sf_dir):
    return bootstrap.mean_variance(panel(spark, sf_dir), 12).withColumn("variance", 1000 * F.col("variance"))


@query(f"WITH RECURSIVE {PANEL}, {oracle.family_sql(499, complete=True)} SELECT {family_columns()} FROM family")
def audit_fixed(spark, sf_dir):
    return with_notes(bootstrap.audit(panel(spark, sf_dir), n_resamples=499, studentization="fixed", search_complete=True))


@query(f"WITH RECURSIVE {PANEL}, {oracle.family_sql(499, resampled=True)} SELECT {family_columns()} FROM family")
def test_returns_resampled(spark, sf_dir):
    return with_notes(bootstrap.test_returns(panel(spark, sf_dir), n_resamples=499))


@query()
def test_returns_certified(spark, sf_dir):
    return bootstrap.test_returns(panel(spark, sf_dir), method="gaussian_ar").drop("interval_bounds", "exact_bounds")


@query()
def reference_column_test(spark, sf_dir):
    return certified.reference_test(panel(spark, sf_dir)).drop("interval_bounds", "exact_bounds")


STEPS = "st AS (SELECT series_id, t - 1 AS t, y AS actual, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS predicted FROM s)"
EVENTS = "s AS MATERIALIZED (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, value AS y FROM events)"
CONFORMAL = f"""WITH RECURSIVE {EVENTS}, {STEPS}, x AS (SELECT * FROM st WHERE t >= 0),
 z AS (SELECT series_id, CAST(-1 AS BIGINT) AS t, 0e0 AS actual, 0e0 AS predicted, 0.5e0 AS q0, 0.5e0 AS q, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS m, false AS miss, 0e0 AS rate FROM (SELECT DISTINCT series_id FROM s)
 UNION ALL SELECT series_id, t, actual, predicted, q0, q0 + rate * (CAST(miss AS INTEGER) - 0.1e0), n, m + CAST(miss AS INTEGER), miss, rate FROM (SELECT x.series_id, x.t, x.actual, x.predicted, z.q AS q0, z.n + 1 AS n, z.m, 0.1e0 * pow(CAST(z.n + 1 AS DOUBLE), -0.5e0) AS rate,
 CASE WHEN z.q < 0 THEN true WHEN z.q >= 1 THEN false ELSE x.actual < x.predicted - 40e0 * z.q / (1 - z.q) OR x.actual > x.predicted + 40e0 * z.q / (1 - z.q) END AS miss FROM z JOIN x ON x.series_id = z.series_id AND x.t = z.t + 1))"""
KIND = "CASE WHEN q0 < 0 THEN 'empty' WHEN q0 >= 1 THEN 'unbounded' ELSE 'finite' END"
RULES = {"alpha": 0.1, "step": 0.1, "decay": 0.5, "scale": 40.0}


def online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value, predicted by the one before it."""
    from pyspark.sql import Window

    s = testdata.event_counts(spark, sf_dir)
    before = F.lag("y").over(Window.partitionBy("series_id").orderBy("t"))
    return s.select("series_id", (F.col("t") - 1).alias("t"), F.col("y").alias("actual"), before.alias("predicted")).where("t >= 0")


@query(CONFORMAL + f" SELECT series_id, t, {r('actual', 'actual')}, {r('predicted', 'predicted')}, {KIND} AS kind, {r('CASE WHEN q0 >= 0 AND q0 < 1 THEN predicted - 40 * q0 / (1 - q0) END', 'lower')}, {r('CASE WHEN q0 >= 0 AND q0 < 1 THEN predicted + 40 * q0 / (1 - q0) END', 'upper')}, miss, {r('rate', 'rate')}, {r('q0', 'quantile')}, {r('q', 'new_quantile')} FROM z WHERE t >= 0")
def adaptive_intervals(spark, sf_dir):
    return conformal.adaptive_intervals(online(spark, sf_dir), **RULES)


@query(CONFORMAL + f" SELECT series_id, {r('arg_max(q, t)', 'quantile')}, max(n) AS n_updates, max(m) AS misses, {r('1 - max(m) / CAST(max(n) AS DOUBLE)', 'coverage')} FROM z GROUP BY 1")
def conformal_state(spark, sf_dir):
    return conformal.conformal_state(online(spark, sf_dir), **RULES)


@query(f"WITH {EVENTS}, {STEPS}, i AS (SELECT series_id, t, actual, predicted - 40e0 * (t % 9) / 9 AS lower, predicted + 40e0 * (t % 7) / 7 AS upper FROM st WHERE t >= 0) SELECT series_id, {r('avg(upper - lower + 20e0 * greatest(lower - actual, 0e0) + 20e0 * greatest(actual - upper, 0e0))', 'mean_score')}, {r('avg(CAST(actual BETWEEN lower AND upper AS INTEGER))', 'coverage')} FROM i GROUP BY 1")
def interval_scores(spark, sf_dir):
    i = online(spark, sf_dir).withColumn("lower", F.col("predicted") - 40.0 * (F.col("t") % 9) / 9).withColumn("upper", F.col("predicted") + 40.0 * (F.col("t") % 7) / 7)
    scored = i.withColumn("score", interval_score(F.col("actual"), F.col("lower"), F.col("upper"), 0.1))
    return scored.groupBy("series_id").agg(F.avg("score").alias("mean_score"), F.avg(F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"))


@query("SELECT k AS t, CASE WHEN q < 0 THEN 'empty' WHEN q >= 1 THEN 'unbounded' ELSE 'finite' END AS kind, " + r("CASE WHEN q >= 0 AND q < 1 THEN 2 * q / (1 - q) END", "radius") + " FROM (SELECT k, (k - 10) / 20e0 AS q FROM (SELECT unnest(range(40)) AS k))")
def interval_kinds(spark, sf_dir):
    q = spark.range(40).select(F.col("id").alias("t"), ((F.col("id") - 10) / F.lit(20.0)).alias("q"))
    return q.select("t", interval_kind(F.col("q")).alias("kind"), interval_radius(F.col("q"), F.lit(2.0)).alias("radius"))


@query(CONFORMAL + f", c AS (SELECT series_id, t, avg(1 - CAST(miss AS INTEGER)) OVER w AS m, count(*) OVER w AS k FROM z WHERE t >= 0 WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) SELECT series_id, CAST(1 AS BIGINT) AS lead_time, {r('max(abs(m - 0.9e0))', 'worst')} FROM c WHERE k = 50 GROUP BY 1")
def worst_local_coverage(spark, sf_dir):
    rows = conformal.adaptive_intervals(online(spark, sf_dir), **RULES).select("series_id", F.lit(1).cast("long").alias("lead_time"), F.col("t").alias("origin"), "actual", "miss")
    return conformal.worst_local_coverage(rows, 0.1, 50)


LEADS = (1, 2, 6)
MULTI_RULES = {"alpha": 0.1, "step": 0.1, "decay": 0.5, "scales": (40.0, 42.0, 45.0), "scale_mode": "blended", "scale_decay": 0.9, "share_weights": (0.0, 0.5, 1.0), "lanes": "interlaced"}
ISSUED = f"WITH RECURSIVE {EVENTS}, {oracle.multistep_sql(LEADS, MULTI_RULES['scales'], MULTI_RULES['share_weights'], alpha=0.1, step=0.1, decay=0.5, keep=0.9)}"
MULTI_DOUBLES = ("predicted", "lower", "upper", "quantile", "scale", "actual", "rate", "new_quantile")


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = testdata.event_counts(spark, sf_dir)
    points = s.select("series_id", F.col("t").alias("origin"), F.explode(F.array(*(F.lit(v).cast("long") for v in LEADS))).alias("lead_time"), F.col("y").alias("predicted"))
    return conformal.multistep_intervals(s, points, LEADS, MULTI_RULES)


@query(f"{ISSUED} SELECT series_id, origin, target_index, lead_time, kind, CAST(miss AS DOUBLE) AS miss, CAST(n_updates AS DOUBLE) AS n_updates, {', '.join(r(c, c) for c in MULTI_DOUBLES)} FROM issued")
def multistep_intervals(spark, sf_dir):
    """All intervals; those without feedback have no miss and no update."""
    return multi(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("miss", "n_updates")})


@query(
    f"""{ISSUED}, sm AS (SELECT *, upper - lower AS width, upper - lower + 20e0 * (greatest(lower - actual, 0e0) + greatest(actual - upper, 0e0)) AS score FROM issued),
 la AS (SELECT series_id, lead_time, sum(1.1e0 / (0.1e0 * pow(k, -0.5e0))) / sum(k) AS bound FROM (SELECT series_id, lead_time, lane, CAST(count(*) AS DOUBLE) AS k FROM issued WHERE actual IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
 ag AS (SELECT series_id, lead_time, count(*) AS issued, count(actual) AS evaluated, count(*) - count(actual) AS pending, avg(CASE WHEN actual IS NOT NULL THEN 1 - CAST(miss AS INTEGER) END) AS coverage, avg(CAST(kind = 'empty' AS INTEGER)) AS empty_rate, avg(CAST(kind = 'unbounded' AS INTEGER)) AS unbounded_rate, avg(width) AS finite_width,
 CASE WHEN count(actual) = 0 THEN 'no feedback' WHEN bool_or(actual IS NOT NULL AND kind = 'empty') THEN 'empty intervals' WHEN bool_or(actual IS NOT NULL AND kind = 'unbounded') THEN 'unbounded intervals' ELSE 'ok' END AS score_status, avg(CASE WHEN actual IS NOT NULL THEN score END) AS score FROM sm GROUP BY 1, 2)
 SELECT series_id, lead_time, issued, evaluated, pending, score_status, {r('coverage', 'coverage')}, {r('empty_rate', 'empty_rate')}, {r('unbounded_rate', 'unbounded_rate')}, {r('finite_width', 'finite_width')}, {r("CASE WHEN score_status = 'ok' THEN score END", 'mean_interval_score')}, {r('least(1e0, bound)', 'coverage_bound')} FROM ag LEFT JOIN la USING (series_id, lead_time)"""
)
def multistep_summary(spark, sf_dir):
    return conformal.interval_summary(multi(spark, sf_dir), 0.1, MULTI_RULES)


def _pair(a: str, b: str) -> str:
    inside = f"(least(greatest(actual, least({a}, {b})), greatest({a}, {b})) - least({a}, {b})) / nullif(greatest({a}, {b}) - least({a}, {b}), 0)"
    return f"sum(ln(1 + 0.5e0 * CASE WHEN {a} = {b} THEN 0e0 WHEN {a} < {b} THEN 2 * {inside} - 1 ELSE 1 - 2 * {inside} END)) OVER w"


def _lse(*v: str) -> str:
    top = f"greatest({', '.join(v)})"
    return f"({top} + ln({' + '.join(f'exp({x} - {top})' for x in v)}))"


MCS = (
    BACK
    + ", f3 AS MATERIALIZED (SELECT origin AS t, max(actual) AS actual, "
    + ", ".join(f"max(CASE WHEN model = '{m}' THEN forecast END) AS f{k}" for k, m in enumerate(CLOSED))
    + " FROM b GROUP BY 1), w3 AS MATERIALIZED (SELECT t, row_number() OVER (ORDER BY t) AS n_updates, "
    + ", ".join(f"{_pair(f'f{i}', f'f{j}')} AS w{i}{j}" for i in range(3) for j in range(3) if i != j)
    + " FROM f3 WINDOW w AS (ORDER BY t)), e3 AS MATERIALIZED (SELECT t, n_updates, "
    + ", ".join(f"{_lse(*(f'w{i}{j}' for j in range(3) if j != i))} - ln(2e0) AS e{i}" for i in range(3))
    + " FROM w3), a3 AS ("
    + " UNION ALL ".join(
        f"SELECT t, n_updates, '{m}' AS model, {i} AS model_ord, e{i} AS e, least(e{i}, {_lse(f'e{i}', 'least(' + ', '.join(f'e{j}' for j in range(3) if j != i) + ')')} - ln(2e0), {_lse('e0', 'e1', 'e2')} - ln(3e0)) AS a FROM e3" for i, m in enumerate(CLOSED)
    )
    + f") SELECT 'all' AS series_id, t, model, CAST(model_ord AS INTEGER) AS model_ord, {r('e', 'log_evalue')}, {r('a', 'log_adjusted')}, bool_and(a < -ln(0.1e0)) OVER (PARTITION BY model ORDER BY t) AS retained, n_updates FROM a3"
)


@query(MCS)
def model_confidence_sets(spark, sf_dir):
    return sequential.sequential_compare(flag_test(spark, sf_dir), 1, list(CLOSED), alpha=0.1, bet=0.5)


@query()
def monte_carlo_study(spark, sf_dir):
    cells = [{"n": 64, "k": 1, "phi": 0.5}, {"n": 64, "k": 5, "phi": 0.5, "cross_corr": 0.3}, {"n": 64, "k": 3, "process": "garch", "delta": 0.5}]
    return simulate.rejection_rates(simulate.study(spark, cells, 40, n_resamples=99))


SIMULATED = "e AS MATERIALIZED (SELECT panel_id, col, name, t, value - avg(value) OVER (PARTITION BY panel_id, col) AS e, count(*) OVER (PARTITION BY panel_id, col) AS n, avg(value) OVER (PARTITION BY panel_id, col) AS mean FROM p), g AS MATERIALIZED (SELECT a.panel_id, a.col, a.name, max(a.n) AS n, max(a.mean) AS mean, h, sum(a.e * b.e) / max(a.n) AS gamma FROM e a CROSS JOIN (SELECT unnest(range(5)) AS h) JOIN e b ON a.panel_id = b.panel_id AND a.col = b.col AND b.t = a.t - h GROUP BY a.panel_id, a.col, a.name, h), f AS MATERIALIZED (SELECT panel_id, col, name, max(n) AS n, max(mean) AS mean, max(CASE WHEN h = 1 THEN gamma END) / max(CASE WHEN h = 0 THEN gamma END) AS phi, sum(CASE WHEN h = 0 THEN gamma ELSE 2 * (1 - h / 5e0) * gamma END) AS lrv FROM g GROUP BY 1, 2, 3)"


@query(f"WITH {oracle.simulated_sql(20, 64, 3, seed=7, phi=0.4, cross=0.2)}, {SIMULATED}, cr AS (SELECT panel_id, avg(c) AS rho FROM (SELECT a.panel_id, a.col, b.col AS other, corr(a.value, b.value) AS c FROM p a JOIN p b ON a.panel_id = b.panel_id AND a.t = b.t AND a.col <> b.col GROUP BY 1, 2, 3) GROUP BY 1) SELECT panel_id, {r('avg(phi)', 'phi')}, {r('greatest(0e0, least(1e0, max(rho)))', 'rho')} FROM f JOIN cr USING (panel_id) GROUP BY 1")
def simulated_panels(spark, sf_dir):
    p = simulate.panels(spark, 20, 64, 3, seed=7, phi=0.4, cross_corr=0.2)
    return hac.fit_equicorrelated(p)


@query(f"WITH {PANEL}, v AS (SELECT col, t // 26 AS half, var_samp(value) AS v FROM p GROUP BY 1, 2 HAVING count(*) > 2) SELECT CAST(col AS INTEGER) AS col, {r('quantile_cont(v, 0.1)', 'p10')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('quantile_cont(v, 0.9)', 'p90')} FROM v GROUP BY 1")
def variance_quantiles(spark, sf_dir):
    v = panel(spark, sf_dir).groupBy("col", F.expr("t div 26").alias("half")).agg(F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 2")
    return v.groupBy("col").agg(*(F.percentile("v", F.lit(q)).alias(n) for q, n in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"))))


@query(_found["adaptive_intervals"][1])
def adaptive_stream(spark, sf_dir):
    """The same intervals by Structured Streaming, the rows arriving in three files."""
    from augurline.streaming.online import adaptive_stream as stream
    from augurline.streaming.run import completed

    return completed(online(spark, sf_dir), lambda s: stream(s, **{k: v for k, v in RULES.items()}))


@query(f"WITH {PANEL} SELECT t, CAST(col AS INTEGER) AS col, name, {r('value', 'value')} FROM p")
def returns_csv(spark, sf_dir):
    """The weekly panel written as CSV and read back by the strict reader."""
    from augurline.sources.returns_csv import read_returns_csv
    from augurline.streaming.run import scratch

    p, folder = panel(spark, sf_dir), scratch(spark, "csv")
    names = [row["name"] for row in p.select("name").distinct().orderBy("name").collect()]
    wide = p.groupBy("t").pivot("name", names).agg(F.first("value")).coalesce(1).sortWithinPartitions("t").drop("t")
    wide.write.option("header", True).csv(folder)
    return read_returns_csv(spark, f"{folder}/*.csv").select("t", "col", "name", "value")


@query("WITH " + BY_PRIORITY + f" SELECT series_id, t, {r('y', 'y')} FROM s")
def tsf_series(spark, sf_dir):
    """Daily series written as one TSF file and read back."""
    from augurline.sources.tsf import observations, read_tsf
    from augurline.streaming.run import scratch

    s, folder = testdata.daily_revenue(spark, sf_dir, "o_orderpriority"), scratch(spark, "tsf")
    lines = s.groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"].cast("string")), ",").alias("v"))
    head = "@relation revenue\n@attribute series_name string\n@frequency daily\n@missing false\n@equallength false\n@data\n"
    text = lines.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(F.concat("series_id", F.lit(":"), "v"))), "\n")).alias("value"))
    text.coalesce(1).write.text(folder)
    return observations(read_tsf(spark, f"{folder}/*.txt"))


@query()
def paired_methods(spark, sf_dir):
    return simulate.paired(simulate.study(spark, [{"n": 64, "k": 4, "phi": 0.6}], 40, n_resamples=99), "iid", "resampled")


def _mass(n: int) -> str:
    return f"(1 + 2 * (SELECT sum((1 - h / {n}e0) * pow(phi, h)) FROM (SELECT CAST(unnest(range(1, {n})) AS DOUBLE) AS h)))"


@query(f"WITH {oracle.simulated_sql(30, 64, 2, seed=3, phi=0.5, cross=0.0)}, {SIMULATED} SELECT panel_id, CAST(col AS INTEGER) AS col, name, {r(f'mean / sqrt(lrv * {_mass(64)} / {_mass(5)} / n)', 'statistic')} FROM f")
def tail_statistics(spark, sf_dir):
    return hac.tail_statistics(simulate.panels(spark, 30, 64, 2, seed=3, phi=0.5), 4, "finite_sample")
