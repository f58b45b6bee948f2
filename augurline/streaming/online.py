"""Streaming forms of the trackers: one state per series, strict integer clocks, the same rows as the batch replays.

Rows of a micro-batch are put in order of time; a time ahead of the clock waits in the state until the gap closes; a repeated or past
time fails the query, since nothing may be dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from augurline.operators.conformal import INTERVALS, MULTI, AdaptiveConformal, MultiStepConformal, multi_rows
from augurline.operators.sequential import ROWS, SequentialModelConfidenceSet

STATE = "blob binary"


def _stateful(stream: DataFrame, make: Callable[[], object], turn: Callable[[object, str, object], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker, clock, waiting = pickle.loads(state.get[0]) if state.exists else (make(), 0, {})
        for frame in frames:
            for row in frame.to_dict("records"):
                t = int(row["t"])
                if t < clock or t in waiting:
                    raise ValueError(f"series {key[0]}: time {t} was already observed")
                waiting[t] = row
        out: list[tuple] = []
        while clock in waiting:
            out += turn(tracker, key[0], waiting.pop(clock))
            clock += 1
        state.update((pickle.dumps((tracker, clock, waiting)),))
        yield pd.DataFrame(out, columns=names)

    return stream.groupBy("series_id").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def adaptive_stream(stream: DataFrame, **options) -> DataFrame:
    """(series_id, t, actual, predicted) to INTERVALS."""

    def turn(tracker: AdaptiveConformal, series: str, row: dict) -> list[tuple]:
        q = tracker.quantile
        kind, lower, upper = tracker.predict(row["predicted"])
        miss, rate, new = tracker.update(row["actual"])
        return [(series, row["t"], row["actual"], row["predicted"], kind, lower, upper, miss, rate, q, new)]

    return _stateful(stream, lambda: AdaptiveConformal(**options), turn, INTERVALS)


def multistep_stream(stream: DataFrame, leads: Sequence[int], **options) -> DataFrame:
    """(series_id, t, y, points: array of a forecast for each lead, or null) to MULTI, each row when its target is observed."""

    def turn(tracker: MultiStepConformal, series: str, row: dict) -> list[tuple]:
        out = multi_rows(series, [], tracker.observe(int(row["t"]), row["y"]))
        if row["points"] is not None:
            tracker.predict(list(row["points"]))
        return out

    return _stateful(stream, lambda: MultiStepConformal(tuple(leads), **options), turn, MULTI)


def confidence_set_stream(stream: DataFrame, models: Sequence[str], **options) -> DataFrame:
    """(series_id, t, actual, points: array of a forecast for each model) to ROWS."""
    names = list(models)

    def turn(tracker: SequentialModelConfidenceSet, series: str, row: dict) -> list[tuple]:
        tracker.predict(list(row["points"]))
        tracker.update(row["actual"])
        return [(series, row["t"], n, i, tracker.log_e[i], tracker.adjusted[i], tracker.retained[i], tracker.n) for i, n in enumerate(names)]

    return _stateful(stream, lambda: SequentialModelConfidenceSet(names, **options), turn, ROWS)
