"""Rolling-origin splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augurline.functions.checks import at_least


@dataclass(frozen=True)
class Rolling:
    """How folds are cut: training from `initial` observations on, `horizon` targets after a `gap`, every `step`.

    window caps the training length (it may be below initial); None lets it expand.  Only whole folds count.
    """

    initial: int
    horizon: int = 1
    step: int = 1
    gap: int = 0
    window: int | None = None

    def __post_init__(self):
        for name in ("initial", "horizon", "step"):
            at_least(getattr(self, name), name)
        at_least(self.gap, "gap", 0)
        if self.window is not None:
            at_least(self.window, "window")

    @property
    def leads(self) -> range:
        """Physical lead times, target less origin."""
        return range(self.gap + 1, self.gap + self.horizon + 1)

    def folds(self, n: int) -> int:
        return max(0, (n - self.gap - self.horizon - self.initial) // self.step + 1)

    def rows(self, n: int) -> list[tuple[int, int, int, int, int]]:
        """(train_start, train_stop, test_start, test_stop, origin) of each fold of n observations."""
        if not self.folds(n):
            raise ValueError("the series is too short for one fold")
        stops = range(self.initial, n - self.gap - self.horizon + 1, self.step)
        return [(0 if self.window is None else max(0, s - self.window), s, s + self.gap, s + self.gap + self.horizon, s - 1) for s in stops]


def rolling_splits(lengths: DataFrame, rolling: Rolling) -> DataFrame:
    """Folds of each series: lengths has series_id and n; a series without a whole fold fails the job."""
    r = rolling
    last = F.col("n") - r.gap - r.horizon
    stops = F.sequence(F.when(last >= r.initial, F.lit(r.initial).cast("long")).otherwise(F.raise_error(F.lit("the series is too short for one fold")).cast("long")), last.cast("long"), F.lit(r.step).cast("long"))
    at = lengths.select("series_id", F.posexplode(stops).alias("fold", "train_stop"))
    start = F.lit(0).cast("long") if r.window is None else F.greatest(F.lit(0).cast("long"), F.col("train_stop") - r.window)
    return at.select("series_id", "fold", start.alias("train_start"), "train_stop", (F.col("train_stop") + r.gap).alias("test_start"), (F.col("train_stop") + r.gap + r.horizon).alias("test_stop"), (F.col("train_stop") - 1).alias("origin"))
