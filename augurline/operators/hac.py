"""Means of dependent series: autocovariances, Bartlett long-run variance, mean inference, tail factors, whitened regression."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from augurline.functions.checks import labels, probability
from augurline.functions.special import normal_ppf, normal_sf, t_ppf, t_sf


def line() -> WindowSpec:
    return Window.partitionBy("panel_id", "col").orderBy("t")


def default_lags(n: int) -> int:
    if n < 8:
        raise ValueError("at least 8 observations are needed")
    return min(math.floor(4 * (n / 100) ** (2 / 9)), n - 2)


def default_block_length(n: int) -> int:
    return min(math.ceil(2 * n ** (1 / 3)), n)


def default_lags_column(n: Column) -> Column:
    return F.least(F.floor(4 * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))), n - 2)


def panel_of(df: DataFrame, panel: str | None, time: list[str], columns: list[str]) -> DataFrame:
    """A wide table as a return panel: panel_id, t, col, name, value."""
    name = F.col(panel).cast("string") if panel else F.lit("all")
    t = (F.row_number().over(Window.partitionBy("panel_id").orderBy(*time)) - 1).cast("long")
    cells = F.array(*(F.struct(F.lit(k).alias("col"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)))
    return df.withColumn("panel_id", name).select("panel_id", t.alias("t"), F.explode(cells).alias("c")).select("panel_id", "t", "c.col", "c.name", "c.value")


def panel_of_array(spark: SparkSession, values: np.ndarray, names: list[str] | None = None, panel_id: str = "all") -> DataFrame:
    """An (observations, columns) array, a vector or a pandas frame as a panel; columns without names are strategy_1, strategy_2, ..."""
    if names is None and hasattr(values, "columns"):
        names = [str(c) for c in values.columns]
    x = np.asarray(values, float)
    x = x[:, None] if x.ndim == 1 else x
    if x.ndim != 2 or not x.size:
        raise ValueError("a vector or a table of numbers is needed")
    names = labels(names or [f"strategy_{k + 1}" for k in range(x.shape[1])])
    if len(names) != x.shape[1]:
        raise ValueError("there must be a name for each column")
    t, col = np.indices(x.shape)
    cells = pd.DataFrame({"panel_id": panel_id, "t": t.ravel(), "col": col.ravel().astype("int32"), "name": np.array(names, object)[col.ravel()], "value": x.ravel()})
    return spark.createDataFrame(cells, "panel_id string, t long, col int, name string, value double")


def labelled(panel: DataFrame) -> DataFrame:
    """Columns without a name are strategy_1, strategy_2, ..."""
    return panel.withColumn("name", F.coalesce("name", F.concat(F.lit("strategy_"), (F.col("col") + 1).cast("string"))))


def checked_panel(panel: DataFrame) -> DataFrame:
    """Fails where a panel isn't rectangular, has fewer than 8 rows, or a column that is nonfinite or constant.

    One pass per panel and column, joined with one pass per panel; the panel itself isn't changed.
    """
    per = panel.groupBy("panel_id", "col").agg(
        F.count(F.lit(1)).alias("n"), F.max("t").alias("last"), F.min("t").alias("first"), F.count_distinct("t").alias("d"), F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("bad"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    fine = (F.col("n") >= 8) & (F.col("d") == F.col("n")) & (F.col("bad") == 0) & (F.col("lo") < F.col("hi"))
    whole = per.groupBy("panel_id").agg((F.bool_and(fine) & (F.min("n") == F.max("n")) & (F.min("first") == F.max("first")) & (F.min("last") == F.max("last")) & (F.max("last") - F.min("first") + 1 == F.max("n")) & (F.max("col") + 1 == F.count(F.lit(1)))).alias("fine"))
    return panel.join(whole, "panel_id").withColumn("value", F.when(F.col("fine"), F.col("value")).otherwise(F.raise_error(F.lit("a panel must be rectangular, finite, not constant, with 8 rows or more")).cast("double"))).drop("fine")


def subtract_benchmark(panel: DataFrame, benchmark: str) -> DataFrame:
    """Each column less the benchmark column of the same time, without the benchmark."""
    at = Window.partitionBy("panel_id", "t")
    base = F.max(F.when(F.col("name") == benchmark, F.col("value"))).over(at)
    order = F.max(F.when(F.col("name") == benchmark, F.col("col"))).over(at)
    rows = panel.withColumn("base", base).withColumn("order", order).where(F.col("name") != benchmark)
    return rows.select("panel_id", "t", (F.col("col") - (F.col("col") > F.col("order")).cast("int")).alias("col"), "name", (F.col("value") - F.col("base")).alias("value"))


def autocovariances(panel: DataFrame, lags: int) -> DataFrame:
    """gamma_0..gamma_lags of each column, with divisor T and one centring by the full-sample mean; one shuffle and sort."""
    whole = Window.partitionBy("panel_id", "col")
    centred = panel.withColumn("e", F.col("value") - F.avg("value").over(whole))
    products = centred.select("panel_id", "col", "name", "value", *((F.col("e") * (F.lag("e", h).over(line()) if h else F.col("e"))).alias(f"p{h}") for h in range(lags + 1)))
    return products.groupBy("panel_id", "col", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), *((F.coalesce(F.sum(f"p{h}"), F.lit(0.0)) / F.count(F.lit(1))).alias(f"gamma{h}") for h in range(lags + 1)))


def long_run_variance(panel: DataFrame, lags: int | None = None) -> DataFrame:
    """panel_id, col, name, n, mean, sd, lags, lrv: gamma_0 + 2 sum (1 - h/(L+1)) gamma_h.

    With a given number of lags these are window sums; the default depends on each panel's length, so its sum runs over arrays.
    A variance that isn't positive fails the job.
    """
    if lags is not None:
        g = autocovariances(panel, lags)
        value = F.col("gamma0")
        for h in range(1, lags + 1):
            value = value + 2.0 * (1.0 - h / (lags + 1.0)) * F.col(f"gamma{h}")
        g = g.select("panel_id", "col", "name", "n", "mean", "sd", F.lit(lags).alias("lags"), value.alias("lrv"))
    else:
        g = panel.groupBy("panel_id", "col", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.array_sort(F.collect_list(F.struct("t", "value"))).alias("x"))
        g = g.withColumn("lags", default_lags_column(F.col("n")).cast("int")).withColumn("e", F.transform("x", lambda r: r["value"] - F.col("mean")))
        value = F.expr("aggregate(sequence(0, lags), 0D, (s, h) -> s + if(h = 0, 1D, 2D * (1D - h / (lags + 1D))) * aggregate(zip_with(slice(e, 1, int(n) - h), slice(e, h + 1, int(n) - h), (a, b) -> a * b), 0D, (u, v) -> u + v) / n)")
        g = g.select("panel_id", "col", "name", "n", "mean", "sd", "lags", value.alias("lrv"))
    return g.withColumn("lrv", F.when(F.col("lrv") > 0, F.col("lrv")).otherwise(F.raise_error(F.lit("the long-run variance must be positive")).cast("double")))


def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(normal_sf)


def normal_tail(z: Column | str) -> Column:
    return F.pandas_udf(_normal_tails, "double")(z)


def student_tail(t: Column | str, df: Column) -> Column:
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([t_sf(x, n) for x, n in zip(a, b, strict=True)])

    return tail(t, df)


def infer_mean(panel: DataFrame, method: str = "hac", lags: int | None = None, confidence: float = 0.95) -> DataFrame:
    """One-sided test of a mean at most 0 and a two-sided interval of each column: Student (iid) or normal (hac)."""
    level = (1 + probability(confidence, "confidence")) / 2
    if method == "hac":
        v = long_run_variance(panel, lags).withColumn("standard_error", F.sqrt(F.col("lrv") / F.col("n")))
        tail, width = normal_tail(F.col("statistic")), F.lit(normal_ppf(level))
    elif method == "iid":
        v = panel.groupBy("panel_id", "col", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))
        tail = student_tail(F.col("statistic"), F.col("n") - 1)

        @F.pandas_udf("double")
        def quantile(n: pd.Series) -> pd.Series:
            return n.map(lambda k: t_ppf(level, int(k) - 1))

        width = quantile("n")
    else:
        raise ValueError("method must be 'iid' or 'hac'")
    v = v.withColumn("statistic", F.col("mean") / F.col("standard_error"))
    half = width * F.col("standard_error")
    return v.select("panel_id", "col", "name", "n", "mean", "standard_error", "statistic", tail.alias("pvalue"), (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def bartlett_mass(phi: float, n: int) -> float:
    """Sum over |h| < n of (1 - |h|/n) phi^|h|: n times the variance of the mean of n values of a unit-variance AR(1)."""
    if n == 1:
        return 1.0
    h = np.arange(1, n, dtype=float)
    return 1 + 2 * float(((1 - h / n) * phi**h).sum())


def ar1_tail_factor(phi: float, lags: int, n: int | None = None) -> float:
    """What a Bartlett sum misses of the variance of an AR(1): target mass over kernel mass; n None means the long run."""
    if not abs(phi) < 1:
        raise ValueError("phi must lie inside (-1, 1)")
    target = (1 + phi) / (1 - phi) if n is None else bartlett_mass(phi, n)
    return target / bartlett_mass(phi, lags + 1)


def first_correlation(panel: DataFrame) -> DataFrame:
    return autocovariances(panel, 1).select("panel_id", "col", "name", "n", "mean", (F.col("gamma1") / F.col("gamma0")).alias("phi"))


def tail_variance(panel: DataFrame, lags: int, target: str = "long_run", phi: float | None = None) -> DataFrame:
    """HAC variance times the tail factor of an estimated or known AR(1) coefficient."""
    base = long_run_variance(panel, lags)
    rows = base.join(first_correlation(panel).select("panel_id", "col", "phi"), ["panel_id", "col"]) if phi is None else base.withColumn("phi", F.lit(float(phi)))

    @F.pandas_udf("double")
    def factor(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([ar1_tail_factor(float(a), lags, None if target == "long_run" else int(b)) for a, b in zip(p, n, strict=True)])

    return rows.withColumn("factor", factor("phi", "n")).withColumn("variance", F.col("lrv") * F.col("factor"))


def fit_equicorrelated(panel: DataFrame) -> DataFrame:
    """phi: mean first autocorrelation; rho: mean correlation between columns, from row sums of standardised data, within [0, 1]."""
    columns = Window.partitionBy("panel_id", "col")
    centred = panel.withColumn("e", F.col("value") - F.avg("value").over(columns))
    z = centred.withColumn("z", F.col("e") / F.sqrt(F.avg(F.col("e") * F.col("e")).over(columns)))
    rows = z.groupBy("panel_id", "t").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("k"))
    rho = rows.groupBy("panel_id").agg(F.avg(F.col("s") * F.col("s")).alias("v"), F.max("k").alias("k"))
    rho = rho.select("panel_id", F.when(F.col("k") > 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - F.col("k")) / (F.col("k") * (F.col("k") - 1))))).otherwise(0.0).alias("rho"))
    return first_correlation(panel).groupBy("panel_id").agg(F.avg("phi").alias("phi")).join(rho, "panel_id")


def known_phi_t(panel: DataFrame, phi: float) -> DataFrame:
    """Generalised least squares t of the mean under a known AR(1) coefficient, the first value from the stationary law."""
    first = F.col("t") == F.min("t").over(Window.partitionBy("panel_id", "col"))
    root = math.sqrt(1 - phi * phi)
    white = panel.select("panel_id", "col", "name", F.when(first, root).otherwise(1 - phi).alias("x"), F.when(first, root * F.col("value")).otherwise(F.col("value") - phi * F.lag("value").over(line())).alias("y"))
    s = white.groupBy("panel_id", "col", "name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    s = s.withColumn("mean", F.col("xy") / F.col("xx")).withColumn("statistic", F.col("mean") / F.sqrt((F.col("yy") - F.col("xy") * F.col("mean")) / (F.col("n") - 1) / F.col("xx")))
    return s.select("panel_id", "col", "name", "n", "mean", "statistic", student_tail("statistic", F.col("n") - 1).alias("pvalue"))


def tail_statistics(panel: DataFrame, lags: int, target: str = "long_run", phi: float | None = None) -> DataFrame:
    """Means studentised by the tail-corrected variance; panels may be simulated draws, as many as there are panel ids."""
    v = tail_variance(panel, lags, target, phi)
    return v.select("panel_id", "col", "name", (F.col("mean") / F.sqrt(F.col("variance") / F.col("n"))).alias("statistic"))
