"""Online conformal intervals: one step ahead, and several leads with delayed feedback.

The trackers here are plain state machines on numbers.  Batch operators replay them over each series inside one group; the streaming
operators (augurline.streaming) keep the same objects as state, so both give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augurline.functions.checks import at_least, finite, probability

INTERVALS = "series_id string, t long, actual double, predicted double, kind string, lower double, upper double, miss boolean, rate double, quantile double, new_quantile double"


def interval(point: float, threshold: float, scale: float) -> tuple[str, float | None, float | None]:
    """(kind, lower, upper): empty below 0, the whole line from 1 on, else a radius of scale * q / (1 - q)."""
    if threshold < 0:
        return "empty", None, None
    if threshold >= 1:
        return "unbounded", None, None
    radius = scale * threshold / (1 - threshold)
    return "finite", point - radius, point + radius


def missed(kind: str, lower: float | None, upper: float | None, actual: float) -> bool:
    return kind == "empty" or kind == "finite" and not lower <= actual <= upper


@dataclass
class AdaptiveConformal:
    """A threshold that rises after a miss and falls after a hit; predict() and update() alternate.

    The threshold is never clipped.  A call that raises changes nothing.
    """

    alpha: float = 0.1
    step: float = 0.05
    decay: float = 0.0
    scale: float = 1.0
    quantile: float = 0.5
    n: int = 0
    misses: int = 0
    pending: tuple | None = None

    def __post_init__(self):
        probability(self.alpha, "alpha")
        if finite(self.step, "step") <= 0 or finite(self.scale, "scale") <= 0 or not 0 <= finite(self.decay, "decay") < 1:
            raise ValueError("step and scale must be positive and decay in [0, 1)")
        finite(self.quantile, "quantile")

    @property
    def coverage(self) -> float | None:
        return 1 - self.misses / self.n if self.n else None

    def predict(self, point: float) -> tuple[str, float | None, float | None]:
        if self.pending is not None:
            raise RuntimeError("an interval is waiting for its outcome")
        self.pending = interval(finite(point, "prediction"), self.quantile, self.scale)
        return self.pending

    def update(self, actual: float) -> tuple[bool, float, float]:
        """(miss, rate, new threshold)."""
        if self.pending is None:
            raise RuntimeError("no interval is waiting")
        miss = missed(*self.pending, finite(actual, "actual"))
        rate = self.step * (self.n + 1) ** -self.decay
        new = self.quantile + rate * (miss - self.alpha)
        self.quantile, self.n, self.misses, self.pending = new, self.n + 1, self.misses + miss, None
        return miss, rate, new


def adaptive_intervals(df: DataFrame, *, alpha: float = 0.1, step: float = 0.05, decay: float = 0.0, scale: float = 1.0, initial_quantile: float = 0.5) -> DataFrame:
    """Replay of AdaptiveConformal over each series (series_id, t, actual, predicted): INTERVALS, bounds null unless finite."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tracker, out = AdaptiveConformal(alpha, step, decay, scale, initial_quantile), []
        for row in pdf.sort_values("t").itertuples():
            q = tracker.quantile
            kind, lower, upper = tracker.predict(row.predicted)
            miss, rate, new = tracker.update(row.actual)
            out.append((row.series_id, row.t, row.actual, row.predicted, kind, lower, upper, miss, rate, q, new))
        return pd.DataFrame(out, columns=[c.split()[0] for c in INTERVALS.split(", ")])

    return df.select("series_id", "t", F.col("actual").cast("double").alias("actual"), F.col("predicted").cast("double").alias("predicted")).groupBy("series_id").applyInPandas(run, INTERVALS)


def conformal_state(df: DataFrame, *, alpha: float = 0.1, step: float = 0.05, decay: float = 0.0, scale: float = 1.0, initial_quantile: float = 0.5) -> DataFrame:
    """The final threshold, updates and misses of each series, as a fold over its ordered array inside the JVM."""
    ordered = df.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "actual", "predicted"))).alias("rows"))
    start = F.struct(F.lit(float(initial_quantile)).alias("q"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))

    def turn(s, r):
        radius = F.lit(float(scale)) * s["q"] / (1.0 - s["q"])
        bounds = (r["actual"] < r["predicted"] - radius) | (r["actual"] > r["predicted"] + radius)
        miss = F.when(s["q"] < 0, 1.0).when(s["q"] >= 1, 0.0).otherwise(bounds.cast("double"))
        n = s["n"] + 1
        rate = F.lit(float(step)) * F.pow(n.cast("double"), F.lit(-float(decay)))
        return F.struct((s["q"] + rate * (miss - alpha)).alias("q"), n.alias("n"), (s["m"] + miss.cast("long")).alias("m"))

    state = F.aggregate("rows", start, turn)
    return ordered.select("series_id", state.alias("s")).select("series_id", F.col("s.q").alias("quantile"), F.col("s.n").alias("n_updates"), F.col("s.m").alias("misses"), (1.0 - F.col("s.m") / F.col("s.n")).alias("coverage"))


@dataclass
class Lane:
    q: float
    n: int = 0
    misses: int = 0


@dataclass
class MultiStepConformal:
    """Intervals for several leads; a lead's threshold learns when its own target has been observed.

    lanes: "pooled" (one controller per lead) or "interlaced" (one per lead and origin modulo lead).  scale_mode: "fixed", "horizon"
    (each lead's own decayed mean square), "shortest" (the first lead's, times the initial ratios) or "blended" (of both, by
    share_weights).  At each time observe() comes first, then predict() at most once.  A call that raises changes nothing.
    """

    leads: Sequence[int]
    alpha: float = 0.1
    step: float | Sequence[float] = 0.05
    decay: float = 0.0
    scales: float | Sequence[float] = 1.0
    initial_quantile: float = 0.5
    lanes: str = "pooled"
    scale_mode: str = "fixed"
    scale_decay: float | None = None
    floors: float | Sequence[float] | None = None
    share_weights: float | Sequence[float] | None = None
    start: int = 0
    state: dict[tuple[int, int], Lane] = field(default_factory=dict)
    pending: dict[int, list[tuple]] = field(default_factory=dict)
    next_time: int = 0
    predicted_at: int | None = None

    def __post_init__(self):
        self.leads = tuple(at_least(v, "lead") for v in self.leads)
        if not self.leads or any(a >= b for a, b in zip(self.leads[:-1], self.leads[1:], strict=True)):
            raise ValueError("leads must rise strictly")
        probability(self.alpha, "alpha")
        self.step, self.scales = self._each(self.step, "step"), list(self._each(self.scales, "scales"))
        if min(self.step) <= 0 or min(self.scales) <= 0 or not 0 <= finite(self.decay, "decay") < 1:
            raise ValueError("steps and scales must be positive and decay in [0, 1)")
        if self.lanes not in ("pooled", "interlaced") or self.scale_mode not in ("fixed", "horizon", "shortest", "blended"):
            raise ValueError("unknown lanes or scale_mode")
        if (self.scale_mode == "fixed") != (self.scale_decay is None):
            raise ValueError("adaptive scales need a scale_decay, fixed ones take none")
        if (self.scale_mode == "blended") != (self.share_weights is not None):
            raise ValueError("share_weights belong to blended scales")
        if self.scale_decay is not None:
            probability(self.scale_decay, "scale_decay")
        self.floors = self._each([s * 1e-6 for s in self.scales] if self.floors is None else self.floors, "floors")
        self.share_weights = self._each(0.0 if self.share_weights is None else self.share_weights, "share_weights")
        if min(self.floors) <= 0 or not all(0 <= w <= 1 for w in self.share_weights):
            raise ValueError("floors must be positive and weights in [0, 1]")
        self.ratios = [s / self.scales[0] for s in self.scales]
        self.own, self.source = list(self.scales), self.scales[0]
        self.next_time = self.start

    def _each(self, value, name: str) -> tuple[float, ...]:
        values = tuple(finite(v, name) for v in value) if isinstance(value, (Sequence, np.ndarray)) and not isinstance(value, str) else (finite(value, name),) * len(self.leads)
        if len(values) != len(self.leads):
            raise ValueError(f"{name} must have one value for each lead")
        return values

    def lane(self, k: int, origin: int) -> tuple[int, int]:
        return k, origin % self.leads[k] if self.lanes == "interlaced" else 0

    def predict(self, points: Sequence[float], scales: Sequence[float] | None = None) -> list[tuple]:
        """(origin, target, lead, point, kind, lower, upper, quantile, scale) of all leads; scales hold for this issue only."""
        now = self.next_time - 1
        if now < self.start or self.predicted_at == now:
            raise RuntimeError("predict once after each observation")
        points, used = self._each(points, "points"), self.scales if scales is None else self._each(scales, "scales")
        if min(used) <= 0:
            raise ValueError("scales must be positive")
        issued = []
        for k, lead in enumerate(self.leads):
            q = self.state.get(self.lane(k, now), Lane(self.initial_quantile)).q
            issued.append((now, now + lead, lead, points[k], *interval(points[k], q, used[k]), q, used[k]))
        for k, row in enumerate(issued):
            self.pending.setdefault(row[1], []).append((k, row))
        self.predicted_at = now
        return issued

    def observe(self, time: int, actual: float) -> list[tuple]:
        """(issued row, actual, miss, rate, new quantile, updates) of the forecasts whose target this is, by lead."""
        if time != self.next_time:
            raise ValueError(f"expected time {self.next_time}, got {time}")
        actual = finite(actual, "actual")
        due = sorted(self.pending.get(time, []), key=lambda x: x[0])
        lanes, updates, matured = {}, [], []
        for k, row in due:
            key = self.lane(k, row[0])
            old = lanes.get(key) or self.state.get(key) or Lane(self.initial_quantile)
            miss = missed(row[4], row[5], row[6], actual)
            rate = self.step[k] * (old.n + 1) ** -self.decay
            lanes[key] = Lane(old.q + rate * (miss - self.alpha), old.n + 1, old.misses + miss)
            updates.append((row, actual, miss, rate, lanes[key].q, lanes[key].n))
            matured.append((k, abs(actual - row[3])))
        own, source, scales = list(self.own), self.source, list(self.scales)
        if self.scale_decay is not None and matured:
            keep, new = math.sqrt(self.scale_decay), math.sqrt(1 - self.scale_decay)
            for k, r in matured:
                if self.scale_mode != "shortest":
                    own[k] = max(self.floors[k], math.hypot(keep * own[k], new * r))
                if k == 0 and self.scale_mode != "horizon":
                    source = max(self.floors[0], math.hypot(keep * source, new * r))
            shared = [max(f, source * ratio) for f, ratio in zip(self.floors, self.ratios, strict=True)]
            if self.scale_mode == "horizon":
                scales = own
            elif self.scale_mode == "shortest":
                scales = shared
            else:
                scales = [mixed(a, b, w) for a, b, w in zip(own, shared, self.share_weights, strict=True)]
        # nothing above changes the tracker
        self.pending.pop(time, None)
        self.state.update(lanes)
        self.own, self.source, self.scales, self.next_time = own, source, scales, time + 1
        return updates

    def lane_state(self, lead: int, origin: int = 0) -> dict:
        """Threshold, updates and misses of the lane that an origin of a lead belongs to."""
        own = self.state.get(self.lane(self.leads.index(lead), origin), Lane(self.initial_quantile))
        return {"quantile": own.q, "n": own.n, "misses": own.misses}

    def to_dict(self) -> dict:
        """The whole tracker in plain values, which JSON can hold; from_dict() goes on where it stopped."""
        settings = {k: getattr(self, k) for k in ("leads", "alpha", "step", "decay", "initial_quantile", "lanes", "scale_mode", "scale_decay", "floors", "start", "next_time", "predicted_at", "scales", "own", "source", "ratios")}
        return settings | {
            "share_weights": self.share_weights if self.scale_mode == "blended" else None,
            "state": [[*key, lane.q, lane.n, lane.misses] for key, lane in sorted(self.state.items())],
            "pending": [[target, [[k, list(row)] for k, row in rows]] for target, rows in sorted(self.pending.items())],
        }

    @classmethod
    def from_dict(cls, held: Mapping) -> MultiStepConformal:
        made = cls(**{k: held[k] for k in ("leads", "alpha", "step", "decay", "scales", "initial_quantile", "lanes", "scale_mode", "scale_decay", "floors", "share_weights", "start")})
        made.own, made.source, made.ratios, made.next_time, made.predicted_at = list(held["own"]), held["source"], list(held["ratios"]), held["next_time"], held["predicted_at"]
        made.state = {(k, lane): Lane(q, n, misses) for k, lane, q, n, misses in held["state"]}
        made.pending = {target: [(k, tuple(row)) for k, row in rows] for target, rows in held["pending"]}
        return made

    def summary(self) -> list[dict]:
        """Per lead: updates, misses, coverage and its bound (at most 1; null without feedback)."""
        out = []
        for k, lead in enumerate(self.leads):
            lanes = [v for (a, _), v in sorted(self.state.items()) if a == k]
            n, misses = sum(v.n for v in lanes), sum(v.misses for v in lanes)
            bound = None
            if n:
                eta = lambda j, k=k: self.step[k] * j**-self.decay
                if self.lanes == "pooled":
                    bound = (1 + sum(eta(j) for j in range(1, min(lead, n) + 1))) / (n * eta(n))
                else:
                    bound = sum(1 / eta(v.n) + self.step[k] / eta(v.n) for v in lanes if v.n) / n
                bound = min(1.0, bound)
            out.append({"lead_time": lead, "n": n, "misses": misses, "coverage": 1 - misses / n if n else None, "coverage_bound": bound, "scale": self.scales[k], "pending": sum(r[2] == lead for p in self.pending.values() for _, r in p)})
        return out


def mixed(own: float, shared: float, weight: float) -> float:
    """(1 - w) own + w shared, exact at the ends and never below the smaller."""
    if weight in (0, 1):
        return shared if weight else own
    top = max(own, shared)
    return max(min(own, shared), top * ((1 - weight) * (own / top) + weight * (shared / top)))


MULTI = "series_id string, origin long, target_index long, lead_time long, predicted double, kind string, lower double, upper double, quantile double, scale double, actual double, miss boolean, rate double, new_quantile double, n_updates long"


def multi_rows(series_id: str, issued: list[tuple], updates: list[tuple]) -> list[tuple]:
    """Output rows of a step: what has matured (with feedback), then nothing else; issued rows follow when they mature or at the end."""
    return [(series_id, *row, actual, miss, rate, q, n) for row, actual, miss, rate, q, n in updates] + [(series_id, *row, None, None, None, None, None) for row in issued]


def multistep_intervals(series: DataFrame, points: DataFrame, leads: Sequence[int], options: Mapping | None = None) -> DataFrame:
    """Replay over each series (series_id, t, y) of the forecasts (series_id, origin, lead_time, predicted): MULTI.

    A forecast appears once: with its feedback, or without where its target lies beyond the series.  An origin must have all leads.
    A series is one task, which reads it in order of time and holds one Arrow batch of it and the tracker.
    """
    leads, options = tuple(leads), dict(options or {})
    wide = points.groupBy("series_id", F.col("origin").alias("t")).agg(F.map_from_entries(F.collect_list(F.struct("lead_time", "predicted"))).alias("at"))
    wide = wide.select("series_id", "t", F.array(*(F.col("at")[F.lit(v)] for v in leads)).alias("points"))
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number isn't coalesced by size: steps are few bytes but much work
    joined = series.join(wide, ["series_id", "t"], "left").repartition(parts, "series_id").sortWithinPartitions("series_id", "t")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tracker, names = None, [c.split()[0] for c in MULTI.split(", ")]
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                tracker = tracker or MultiStepConformal(leads, start=int(row.t), **options)
                out += multi_rows(row.series_id, [], tracker.observe(int(row.t), row.y))
                if row.points is not None:
                    tracker.predict(list(row.points))
            yield pd.DataFrame(out, columns=names)
        left = [r for target in sorted(tracker.pending) for _, r in tracker.pending[target]]
        yield pd.DataFrame(multi_rows(row.series_id, left, []), columns=names)

    return joined.groupBy("series_id").applyInPandas(run, MULTI)


def interval_summary(rows: DataFrame, alpha: float, rules: Mapping | None = None) -> DataFrame:
    """Per series and lead of MULTI rows: counts, coverage, shares, width and mean interval score with its status.

    With the rules of the intervals (step, decay, lanes) there is also the bound of the coverage error that they guarantee, at most 1
    and null without feedback.  The rows are read once.
    """
    interlaced = rules is not None and rules.get("lanes", "pooled") != "pooled"
    done, is_kind = F.col("actual").isNotNull(), lambda k: F.col("kind") == k
    width = F.col("upper") - F.col("lower")
    score = width + (2.0 / alpha) * (F.greatest(F.col("lower") - F.col("actual"), F.lit(0.0)) + F.greatest(F.col("actual") - F.col("upper"), F.lit(0.0)))
    lane = F.col("origin") % F.col("lead_time") if interlaced else F.lit(0)
    lanes = rows.groupBy("series_id", "lead_time", lane.alias("lane")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("k"), F.count_if(done & ~F.col("miss")).alias("hits"),
        *(F.count_if(c & is_kind(kind)).alias(kind + name) for kind in ("empty", "unbounded", "finite") for c, name in ((F.lit(True), ""), (done, "_done"))),
        F.sum(F.when(is_kind("finite"), width)).alias("width"), F.sum(F.when(done & is_kind("finite"), score)).alias("score"),
    )
    mean = lambda c, n: F.try_divide(F.sum(c), F.sum(n))
    g = lanes.groupBy("series_id", "lead_time").agg(
        F.sum("n").alias("issued"), F.sum("k").alias("evaluated"), (F.sum("n") - F.sum("k")).alias("pending"), mean("hits", "k").alias("coverage"),
        mean("empty", "n").alias("empty_rate"), mean("unbounded", "n").alias("unbounded_rate"), mean("width", "finite").alias("finite_width"),
        F.sum("empty_done").alias("e"), F.sum("unbounded_done").alias("u"), mean("score", "finite_done").alias("s"),
        *([] if rules is None else [coverage_bound(rules, interlaced).alias("coverage_bound")]),
    )
    status = F.when(F.col("evaluated") == 0, "no feedback").when(F.col("e") > 0, "empty intervals").when(F.col("u") > 0, "unbounded intervals").otherwise("ok")
    g = g.withColumn("score_status", status).withColumn("mean_interval_score", F.when(F.col("score_status") == "ok", F.col("s"))).drop("e", "u", "s")
    return g if rules is None else g.select(*(c for c in g.columns if c != "coverage_bound"), "coverage_bound")


def coverage_bound(rules: Mapping, interlaced: bool) -> Column:
    """The bound of a lead over its lanes, each with k rows with feedback, for one step of all leads; an aggregate by series and lead."""
    step, decay = float(rules.get("step", 0.05)), float(rules.get("decay", 0.0))
    eta = lambda j: F.lit(step) * F.pow(j, F.lit(-decay))
    n = F.sum("k")
    if interlaced:
        bound = F.sum(F.when(F.col("k") > 0, (1 + F.lit(step)) / eta(F.col("k")))) / n
    else:
        first = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.max("lead_time"), n)), F.lit(0.0), lambda a, j: a + eta(j))
        bound = (1 + first) / (n * eta(n))
    return F.when(n > 0, F.least(F.lit(1.0), bound))


def worst_local_coverage(rows: DataFrame, alpha: float, window: int) -> DataFrame:
    """Largest deviation of a moving mean of coverage over whole windows from 1 - alpha, per series and lead."""
    w = Window.partitionBy("series_id", "lead_time").orderBy("origin").rowsBetween(1 - window, 0)
    done = rows.where("actual is not null").select("series_id", "lead_time", "origin", (~F.col("miss")).cast("double").alias("c"))
    moving = done.select("series_id", "lead_time", F.avg("c").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") == window)
    return moving.groupBy("series_id", "lead_time").agg(F.max(F.abs(F.col("m") - (1 - alpha))).alias("worst"))
