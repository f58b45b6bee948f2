"""Exact moments of means and Bartlett variances of a stationary Gaussian AR(1) with unit marginal variance."""

from __future__ import annotations

import numpy as np

from augurline.functions.checks import at_least
from augurline.operators.hac import bartlett_mass

LARGEST = 2048


def ar1_mean_variance(n: int, phi: float) -> float:
    """The variance of the mean of n values."""
    if not abs(phi) < 1:
        raise ValueError("phi must lie inside (-1, 1)")
    return bartlett_mass(phi, at_least(n, "n")) / n


def ar1_hac_moments(n: int, phi: float, lags: int) -> tuple[float, float]:
    """Mean and variance of the Bartlett variance of n values, centred by their mean.

    It is the quadratic form x' A x / n with A the kernel matrix centred on both sides, so the mean is tr(A S) / n and the variance
    2 tr(A S A S) / n^2 for covariance S.  n is at most 2048, as these are dense matrices.
    """
    if at_least(n, "n", 2) > LARGEST or not abs(phi) < 1 or not 0 <= lags <= n - 2:
        raise ValueError("2 <= n <= 2048, |phi| < 1 and 0 <= lags <= n - 2 are needed")
    gap = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    kernel = np.clip(1 - gap / (lags + 1), 0, None)
    kernel = kernel - kernel.mean(axis=0) - kernel.mean(axis=1)[:, None] + kernel.mean()
    product = kernel @ (float(phi) ** gap)
    return float(np.trace(product)) / n, 2 * float((product * product.T).sum()) / n**2
