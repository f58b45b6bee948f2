"""Simulated panels and Monte-Carlo studies; every replicate has its own addressed seed, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurline.functions.special import binomial_two_sided, clopper_pearson_upper, normal_sf, t_ppf, t_sf, wilson
from augurline.operators import bootstrap

#: Fixed values of the GARCH process.
ARCH, GARCH = 0.06, 0.90


def seed_of(root: int, *address: int) -> int:
    return int(np.random.SeedSequence(root, spawn_key=address).generate_state(1, np.uint64)[0])


def simulate(n: int, k: int, process: str = "gaussian_ar", *, phi: float = 0.0, cross_corr: float = 0.0, sigma: float = 1.0, mean: float | Sequence[float] = 0.0, seed: int = 0, burnin: int = 500) -> np.ndarray:
    """An (n, k) panel: Gaussian AR(1) from its stationary law, Student (5) AR(1), or GARCH(1, 1); columns share a common factor."""
    if not 0 <= cross_corr <= 1 or not abs(phi) < 1:
        raise ValueError("cross_corr must lie in [0, 1] and phi inside (-1, 1)")
    rng = np.random.default_rng(seed)

    def shocks(rows: int) -> np.ndarray:
        common, own = rng.standard_normal((rows, 1)), rng.standard_normal((rows, k))
        z = np.sqrt(cross_corr) * common + np.sqrt(1 - cross_corr) * own
        if process == "student_ar":
            z = z * np.sqrt(3 / rng.chisquare(5, (rows, 1)))
        return z

    if process == "gaussian_ar":
        z = shocks(n)
        z[1:] *= np.sqrt(1 - phi * phi)
    elif process == "student_ar":
        z = shocks(n + burnin) * np.sqrt(1 - phi * phi)
    elif process == "garch":
        z = shocks(n + burnin)
        variance = np.ones(k)
        for t in range(len(z)):
            z[t] *= np.sqrt(variance)
            variance = (1 - ARCH - GARCH) + ARCH * z[t] ** 2 + GARCH * variance
    else:
        raise ValueError(f"unknown process {process!r}")
    if process != "garch":
        for t in range(1, len(z)):
            z[t] += phi * z[t - 1]
    return np.asarray(mean) + sigma * z[-n:]


def panels(spark: SparkSession, replicates: int, n: int, k: int, *, seed: int = 0, **options) -> DataFrame:
    """One simulated panel per replicate: panel_id, t, col, name, value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf["id"]:
                x = simulate(n, k, seed=seed_of(seed, int(r)), **options)
                t, c = np.indices(x.shape)
                yield pd.DataFrame({"panel_id": str(r), "t": t.ravel(), "col": c.ravel(), "name": [f"strategy_{i + 1}" for i in c.ravel()], "value": x.ravel()})

    return spark.range(replicates).mapInPandas(run, "panel_id string, t long, col int, name string, value double")


def factor_panel(n: int, k: int, *, phi: float, factor_phi: float, share: float, sigma: float = 1.0, seed: int = 0) -> np.ndarray:
    """An (n, k) panel of stationary Gaussian AR(1) columns plus a common AR(1) factor with a coefficient of its own.

    share is the factor's part of each column's variance.
    """
    if not 0 <= share <= 1 or not abs(phi) < 1 or not abs(factor_phi) < 1:
        raise ValueError("share must lie in [0, 1] and both coefficients inside (-1, 1)")
    own, factor = (simulate(n, m, phi=p, seed=seed_of(seed, i)) for i, (m, p) in enumerate(((k, phi), (1, factor_phi))))
    return sigma * (np.sqrt(share) * factor + np.sqrt(1 - share) * own)


def scenario(n: int, kind: str, *, phi: float = 0.6, seed: int = 0) -> np.ndarray:
    """An AR path with constant or changing scale, a break of the coefficient, or Student shocks."""
    rng = np.random.default_rng(seed)
    shock = rng.standard_t(5, n) * np.sqrt(0.6) if kind == "student" else rng.standard_normal(n)
    scale = np.ones(n)
    if kind == "stochastic_scale":
        level = 0.0
        for t in range(n):
            level = 0.98 * level + 0.15 * rng.standard_normal()
            scale[t] = np.exp(level)
    elif kind == "step_scale":
        scale[n // 2 :] = 2.5
    elif kind not in ("constant", "coefficient_break", "student"):
        raise ValueError(f"unknown scenario {kind!r}")
    y = np.empty(n)
    last = 0.0
    for t in range(n):
        p = -phi if kind == "coefficient_break" and t >= n // 2 else phi
        y[t] = last = p * last + np.sqrt(1 - p * p) * shock[t] * scale[t]
    return y


CELL = "cell int, replicate long, method string, reject boolean, pvalue double"


def study(spark: SparkSession, cells: Sequence[dict], replicates: int, *, n_resamples: int = 199, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Decisions of iid and HAC winner tests and of fixed and resampled family tests for each cell and replicate.

    A cell has n, k and the options of simulate(); delta shifts the first column's mean.  Each (cell, replicate) is a row of its own,
    so replicates spread over all tasks.
    """
    cells = [dict(c) for c in cells]
    grid = spark.range(len(cells) * replicates).repartition(spark.sparkContext.defaultParallelism * 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i in pdf["id"].tolist():
                cell, replicate = divmod(i, replicates)
                spec = dict(cells[cell])
                n, k, delta = spec.pop("n"), spec.pop("k"), spec.pop("delta", 0.0)
                x = simulate(n, k, seed=seed_of(seed, cell, replicate, 0), **spec)
                x[:, 0] += delta
                m, se, lags = bootstrap._observed(x, None)
                t, iid = m / se, m / (x.std(axis=0, ddof=1) / np.sqrt(n))
                found = {"iid": t_sf(iid.max(), n - 1), "hac": normal_sf(t.max())}
                index = bootstrap.draw_indices(n, bootstrap.default_block_length(n), seed_of(seed, cell, replicate, 1), 0, n_resamples)
                fixed = (bootstrap.means(x - m, index) / se).max(axis=1)
                again = bootstrap.statistics(x - m, index, lags).max(axis=1)
                found |= {"fixed": (1 + (fixed >= t.max()).sum()) / (n_resamples + 1), "resampled": (1 + (again >= t.max()).sum()) / (n_resamples + 1)}
                out += [(cell, replicate, method, bool(p <= alpha), float(p)) for method, p in found.items()]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CELL.split(", ")])

    return grid.mapInPandas(run, CELL)


def rejection_rates(decisions: DataFrame, limit_level: float = 0.05) -> DataFrame:
    """Rates of each cell and method with Wilson intervals and upper limits that hold for all cells and methods at once."""
    counts = decisions.groupBy("cell", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if("reject").alias("rejections"))
    tests = counts.agg(F.count(F.lit(1))).first()[0] or 1

    @F.pandas_udf("struct<low: double, high: double, upper: double>")
    def limits(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*wilson(int(a), int(b)), clopper_pearson_upper(int(a), int(b), limit_level / tests)) for a, b in zip(x, n, strict=True)], columns=["low", "high", "upper"])

    return counts.withColumn("l", limits("rejections", "n")).select("cell", "method", "n", "rejections", (F.col("rejections") / F.col("n")).alias("rate"), "l.low", "l.high", "l.upper")


def paired(decisions: DataFrame, first: str, second: str) -> DataFrame:
    """Risk difference of two methods on the same replicates, its standard error and McNemar's exact p-value, by cell."""
    a = decisions.where(F.col("method") == first).select("cell", "replicate", F.col("reject").cast("int").alias("a"))
    b = decisions.where(F.col("method") == second).select("cell", "replicate", F.col("reject").cast("int").alias("b"))
    d = a.join(b, ["cell", "replicate"]).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("a") - F.col("b")).alias("difference"), F.stddev_samp(F.col("a") - F.col("b")).alias("sd"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_first"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_second"))

    @F.pandas_udf("double")
    def mcnemar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([binomial_two_sided(int(u), int(u + v)) for u, v in zip(x, y, strict=True)])

    return d.select("cell", "n", "difference", (F.col("sd") / F.sqrt("n")).alias("standard_error"), "only_first", "only_second", mcnemar("only_first", "only_second").alias("mcnemar_pvalue"))


def mean_interval(df: DataFrame, keys: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Mean, Monte-Carlo error and Student interval by keys; nulls with fewer than two values."""

    @F.pandas_udf("double")
    def width(n: pd.Series) -> pd.Series:
        return n.map(lambda k: t_ppf((1 + confidence) / 2, int(k) - 1) if k > 1 else None)

    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("mcse"))
    half = width("n") * F.col("mcse")
    return g.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def calibrated_level(pvalues: DataFrame, alpha: float) -> DataFrame:
    """The ceil((1 - alpha)(n + 1))-th smallest statistic of each cell (null beyond n)."""
    from pyspark.sql import Window

    w = Window.partitionBy("cell").orderBy("statistic")
    ranked = pvalues.select("cell", "statistic", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("cell")).alias("n"))
    return ranked.groupBy("cell").agg(F.max(F.when(F.col("r") == F.ceil((1 - alpha) * (F.col("n") + 1)), F.col("statistic"))).alias("cutoff"))


def replayed(spark: SparkSession, x: np.ndarray, statistic: Callable[[np.ndarray], float], draws: int, *, phi: float, rho: float, seed: int = 0) -> float:
    """(1 + #{draw >= observed}) / (draws + 1) for a statistic of panels simulated with fitted parameters."""
    n, k, observed = len(x), x.shape[1], statistic(x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"s": [statistic(simulate(n, k, phi=phi, cross_corr=rho, seed=seed_of(seed, int(b)))) for b in pdf["id"]]})

    above = spark.range(draws).mapInPandas(run, "s double").agg(F.count_if(F.col("s") >= observed)).first()[0]
    return (1 + above) / (draws + 1)
