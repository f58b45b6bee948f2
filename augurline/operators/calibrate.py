"""The calibration study: false and true rejections of five tests over simulated cells, each replicate a row of its own.

A cell is one simulation setting.  Its replicates share their draws between the methods, between nested families of columns (running
maxima) and between shifts of the first column's mean, since translation changes neither centred draws nor standard errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augurline.functions.special import clopper_pearson_upper, equicorrelated_max_quantile, normal_ppf, t_ppf, wilson
from augurline.operators import bootstrap, simulate
from augurline.operators.reference import ar1_mean_variance

# Fixed values of the study.
SEED, ALPHA, SIGMA, CORRELATION, BURNIN, LIMIT = 20261004, 0.05, 0.01, 0.35, 512, 0.07
PROFILES = {"quick": {"n": 256, "replicates": 40, "resamples": 99, "fewer": 20}, "full": {"n": 512, "replicates": 2000, "resamples": 999, "fewer": 1000}}
COUNTS, DELTAS, MULTIPLES = (1, 5, 10, 25, 50), (0, 1, 2, 3, 4), (0.5, 1.0, 2.0, 4.0)
HOLDOUT = (
    (256, "gaussian_ar", 0.7, 0.0), (1024, "gaussian_ar", 0.7, 0.8), (2048, "gaussian_ar", 0.9, 0.35), (1024, "student_ar", 0.7, 0.0), (1024, "garch", 0.0, 0.8), (512, "gaussian_ar", -0.4, 0.35)
)


def cells(profile: str = "quick") -> list[dict]:
    """The cells of all stages: dependence, selection, process, holdout, and sensitivity to the block length."""
    if profile not in PROFILES:
        raise ValueError("profile must be 'quick' or 'full'")
    p = PROFILES[profile]

    def cell(stage: str, study: int, address: int, process: str, phi: float, k: int, **more) -> dict:
        return {"stage": stage, "address": (study, address), "process": process, "phi": phi, "k": k, "n": p["n"], "cross_corr": CORRELATION, "replicates": p["replicates"] if study < 14 else p["fewer"], "counts": (k,), "deltas": (0,), "multiples": (1.0,)} | more

    out = [cell("dependence", 11, i, "gaussian_ar", phi, 1) for i, phi in enumerate((0.0, 0.2, 0.4, 0.6, 0.8))]
    out.append(cell("selection", 12, 0, "gaussian_ar", 0.5, max(COUNTS), counts=COUNTS))
    out += [cell("process", 13, i, process, phi, 20, deltas=DELTAS) for i, (process, phi) in enumerate((("gaussian_ar", 0.5), ("student_ar", 0.5), ("garch", 0.0)))]
    out += [cell("holdout", 14, i, process, phi, 10, n=n, cross_corr=rho) for i, (n, process, phi, rho) in enumerate(HOLDOUT)]
    return out + [cell("sensitivity", 15, i, "gaussian_ar", phi, k, multiples=MULTIPLES) for i, (phi, k) in enumerate(((0.8, 1), (0.5, 50)))]


DECISION = "cell int, replicate long, block_length double, n_columns int, delta int, method string, reject boolean, ratio double"


def replicate(cell: dict, number: int, at: int, *, resamples: int, alpha: float, seed: int) -> Iterator[tuple]:
    """DECISION rows of one replicate; rows with a ratio (of an estimated to the true variance of the mean) have no decision."""
    n, k, phi, rho, gaussian = cell["n"], cell["k"], cell["phi"], cell["cross_corr"], cell["process"] == "gaussian_ar"
    x = simulate.simulate(n, k, cell["process"], phi=phi, cross_corr=rho, sigma=SIGMA, burnin=BURNIN, seed=simulate.seed_of(seed, *cell["address"], number, 0))
    mean, error, lags = bootstrap._observed(x, None)
    plain = x.std(axis=0, ddof=1) / math.sqrt(n)
    true = SIGMA**2 * ar1_mean_variance(n, phi) if gaussian else None
    shift = SIGMA * math.sqrt((1 + phi) / (1 - phi) / n)
    for multiple in cell["multiples"]:
        length = min(n, max(1, bootstrap.default_block_length(n) * multiple))
        index = bootstrap.draw_indices(n, length, simulate.seed_of(seed, *cell["address"], number, 1), 0, resamples)
        tops = {"fixed": np.maximum.accumulate(bootstrap.means(x - mean, index) / error, axis=1), "resampled": np.maximum.accumulate(bootstrap.statistics(x - mean, index, lags), axis=1)}
        for columns in cell["counts"]:
            for delta in cell["deltas"]:
                moved = mean[:columns] + np.where(np.arange(columns) == 0, delta * shift, 0.0)
                best = int(np.argmax(moved / error[:columns]))
                t = moved[best] / error[best]
                found = {"iid": moved[best] / plain[best] >= t_ppf(1 - alpha, n - 1), "hac": t >= normal_ppf(1 - alpha)}
                found |= {m: 1 + (top[:, columns - 1] >= t).sum() <= alpha * (resamples + 1) for m, top in tops.items()}
                if gaussian:
                    found["oracle"] = (moved / math.sqrt(true)).max() >= equicorrelated_max_quantile(1 - alpha, columns, rho)
                yield from ((at, number, float(length), columns, delta, m, bool(r), None) for m, r in found.items())
        if gaussian:
            yield (at, number, float(length), k, 0, "hac variance", None, float(np.median(error**2 / true)))


def decisions(spark: SparkSession, grid: list[dict], *, resamples: int = 99, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """DECISION rows of all cells and replicates, dealt over all tasks."""
    listed = spark.createDataFrame([(i, c["replicates"]) for i, c in enumerate(grid)], "cell int, n int")
    rows = listed.select("cell", F.explode(F.expr("sequence(0L, n - 1L)")).alias("replicate")).repartition(4 * spark.sparkContext.defaultParallelism, "cell", "replicate")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, number in zip(pdf["cell"].tolist(), pdf["replicate"].tolist(), strict=True):
                yield pd.DataFrame(replicate(grid[at], number, at, resamples=resamples, alpha=alpha, seed=seed), columns=[c.split()[0] for c in DECISION.split(", ")])

    return rows.mapInPandas(run, DECISION)


def rates(found: DataFrame, grid: list[dict], confidence: float = 0.95) -> list[dict]:
    """A row for each cell, block length, family, shift and method, with its interval.

    The assessed ones, resampled tests without a shift outside the sensitivity stage, have an upper limit that holds for all of them.
    """
    keys = ["cell", "block_length", "n_columns", "delta", "method"]
    counted = found.where("reject is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("reject").alias("rejections")).orderBy(*keys).collect()
    rows = [r.asDict() | {x: grid[r["cell"]][x] for x in ("stage", "process", "phi", "cross_corr")} | {"n_observations": grid[r["cell"]]["n"]} for r in counted]
    assessed = [r for r in rows if r["method"] == "resampled" and r["delta"] == 0 and r["stage"] != "sensitivity"]
    for r in rows:
        r["rate"] = r["rejections"] / r["n"]
        r["low"], r["high"] = wilson(r["rejections"], r["n"], confidence)
        r["upper"] = clopper_pearson_upper(r["rejections"], r["n"], (1 - confidence) / len(assessed)) if r in assessed else None
    return rows


def variance_ratios(found: DataFrame) -> DataFrame:
    """Quantiles of the estimated over the true variance of the mean, by cell and block length."""
    ratio = found.where("ratio is not null").groupBy("cell", "block_length", "method")
    return ratio.agg(*(F.percentile("ratio", F.lit(q)).alias(name) for q, name in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"))))


def assessment(rows: list[dict], profile: str) -> str:
    """'smoke only' for the quick profile; else whether all simultaneous upper limits keep to the limit."""
    if profile == "quick":
        return "smoke only"
    return "passed" if all(r["upper"] <= LIMIT for r in rows if r["upper"] is not None) else "failed"
