"""Distribution functions in plain Python and NumPy, for driver parameters and small result rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import numpy as np

NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NORMAL.inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 20_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return value


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def inverted(cdf: Callable[[float], float], p: float, low: float, high: float) -> float:
    """The x with cdf(x) = p by bisection to the last bit."""
    for _ in range(2000):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


def beta_ppf(p: float, a: float, b: float) -> float:
    return inverted(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def t_sf(t: float, df: float) -> float:
    tail = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return tail if t >= 0 else 1 - tail


@lru_cache(maxsize=4096)
def t_ppf(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf(1 - p, df)
    high = 1.0
    while t_sf(high, df) > 1 - p:
        high *= 2
    return inverted(lambda t: -t_sf(t, df), p - 1, 0.0, high)


def binomial_two_sided(k: int, n: int) -> float:
    """The exact two-sided p-value of k successes of n at one half (McNemar)."""
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


def wilson(successes: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """The Wilson interval of a share, its ends exact at 0 and n successes."""
    z = normal_ppf((1 + confidence) / 2)
    p, q = successes / n, z * z / n
    centre, half = (p + q / 2) / (1 + q), math.sqrt(p * (1 - p) * q + q * q / 4) / (1 + q)
    return (0.0 if successes == 0 else max(0.0, centre - half)), (1.0 if successes == n else min(1.0, centre + half))


def clopper_pearson_upper(successes: int, n: int, level: float) -> float:
    """The exact one-sided upper limit of a share at error level."""
    return 1.0 if successes >= n else beta_ppf(1 - level, successes + 1, n - successes)


@lru_cache(maxsize=256)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def equicorrelated_max_cdf(x: float, k: int, rho: float) -> float:
    """P(max of k standard normals with common correlation rho <= x) by quadrature over the common factor."""
    if rho <= 0 or k == 1:
        return (1 - normal_sf(x)) ** k
    if rho >= 1:
        return 1 - normal_sf(x)
    total, (at, weight) = 0.0, _nodes(64)
    # the integrand turns over a width of sqrt(1 - rho) / sqrt(rho) around x / sqrt(rho)
    centre, width = x / math.sqrt(rho), math.sqrt((1 - rho) / rho)
    edges = sorted({-9.0, 9.0, *(e for s in (-8, -4, -2, 0, 2, 4, 8) if -9 < (e := centre + s * width) < 9), -4.0, 0.0, 4.0})
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        z = (a + b) / 2 + (b - a) / 2 * at
        inner = np.array([1 - normal_sf((x - math.sqrt(rho) * v) / math.sqrt(1 - rho)) for v in z]) ** k
        total += (b - a) / 2 * float((weight * inner * np.exp(-z * z / 2)).sum()) / math.sqrt(2 * math.pi)
    return min(1.0, total)


@lru_cache(maxsize=1024)
def equicorrelated_max_quantile(p: float, k: int, rho: float) -> float:
    return inverted(lambda x: equicorrelated_max_cdf(x, k, rho), p, -12.0, 12.0)
