"""Losses and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from augurline.functions.checks import asserted, is_finite, probability


def forecast_loss(actual: Column, predicted: Column, loss: str = "squared", quantile: float | None = None) -> Column:
    """Squared, absolute or pinball loss; an overflow fails the job."""
    error = actual - predicted
    if (loss == "pinball") != (quantile is not None):
        raise ValueError("a quantile belongs to the pinball loss and to it alone")
    if loss == "squared":
        value = error * error
    elif loss == "absolute":
        value = F.abs(error)
    elif loss == "pinball":
        q = probability(quantile, "quantile")
        value = F.greatest(F.lit(q) * error, F.lit(q - 1.0) * error)
    else:
        raise ValueError(f"unknown loss {loss!r}")
    return asserted(value, is_finite(value), "a loss is not finite")


def interval_score(actual: Column, lower: Column, upper: Column, alpha: float) -> Column:
    """Width plus 2/alpha times the distance by which the outcome lies outside; an unbounded interval scores infinity."""
    scale = F.lit(2.0 / probability(alpha, "alpha"))
    below, above = F.greatest(lower - actual, F.lit(0.0)), F.greatest(actual - upper, F.lit(0.0))
    infinite = F.lit(float("inf"))
    unbounded = (lower == -infinite) | (upper == infinite)
    valid = ~F.isnan(lower) & ~F.isnan(upper) & (lower <= upper) & (lower < infinite) & (upper > -infinite)
    score = F.when(unbounded, infinite).otherwise((upper - lower) + scale * below + scale * above)
    return asserted(score, valid, "interval bounds must be ordered and open outward")


def bounded_score(residual: Column, scale: Column) -> Column:
    """r / (scale + r) for an absolute residual, without overflow."""
    r = F.abs(residual)
    return F.when(r <= scale, (r / scale) / (1.0 + r / scale)).otherwise(1.0 / (1.0 + scale / r))


def interval_kind(threshold: Column) -> Column:
    return F.when(threshold < 0, "empty").when(threshold >= 1, "unbounded").otherwise("finite")


def interval_radius(threshold: Column, scale: Column) -> Column:
    """scale * q / (1 - q) for 0 <= q < 1, else null."""
    return F.when((threshold >= 0) & (threshold < 1), scale * threshold / (1.0 - threshold))


def log_sum_exp(values: Column) -> Column:
    """Of an array column; minus infinity entries count nothing."""
    top = F.array_max(values)
    return F.when(top == float("-inf"), top).otherwise(top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))))


def learning_rate(step: Column, n: Column, decay: float) -> Column:
    return step * F.pow(n.cast("double"), F.lit(-decay))


def ewma_scale(previous: Column, residual: Column, decay: float, floor: Column) -> Column:
    """max(floor, root of the decayed mean square)."""
    return F.greatest(floor, F.hypot(F.lit(decay**0.5) * previous, F.lit((1 - decay) ** 0.5) * F.abs(residual)))


def blend(own: Column, shared: Column, weight: Column) -> Column:
    top, low = F.greatest(own, shared), F.least(own, shared)
    mixed = F.greatest(low, top * ((1.0 - weight) * (own / top) + weight * (shared / top)))
    return F.when(weight == 0, own).when(weight == 1, shared).otherwise(mixed)


def pair_difference(actual: Column, first: Column, second: Column, quantile: float | None = None) -> Column:
    """The normalised loss difference in [-1, 1] of two forecasts; positive: the first is worse.

    The outcome is clipped to the span of the forecasts, where losses are linear.  Absolute loss without a quantile, else pinball.
    """
    low, high = F.least(first, second), F.greatest(first, second)
    inside = F.least(F.greatest(actual, low), high)
    part = (inside - low) / (high - low)
    sign = F.when(first < second, 1.0).otherwise(-1.0)
    value = sign * (2.0 * part - 1.0) if quantile is None else sign * (part - (1.0 - quantile)) / max(quantile, 1.0 - quantile)
    return F.when(first == second, 0.0).otherwise(value)
