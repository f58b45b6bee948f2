"""Online trackers against exact fractions and brute force; streams against replays."""

import itertools
import math
from fractions import Fraction as Q

import numpy as np
import pytest
from pyspark.sql import functions as F

from augurline.operators import conformal, sequential
from augurline.streaming import online

ACTUAL = [0, 4, -2, 0, 8, -1, 0, 12, 0, -8, 0, 2]
POINTS = [0, 1, 0, -1, 2, 0, 1, 3, 0, -2, 0, 0]


def test_one_step_recursion(spark):
    q, n, misses, rows = Q(1, 2), 0, 0, []
    for y, p in zip(ACTUAL, POINTS, strict=True):
        radius = 2 * q / (1 - q) if 0 <= q < 1 else None
        miss = q < 0 or q < 1 and abs(Q(y) - p) > radius
        rows.append((q, miss))
        q += Q(1, 8) * (miss - Q(1, 4))
        n, misses = n + 1, misses + miss
    options = {"alpha": 0.25, "step": 0.125, "decay": 0.0, "scale": 2.0, "initial_quantile": 0.5}
    df = spark.createDataFrame([("s", t, float(y), float(p)) for t, (y, p) in enumerate(zip(ACTUAL, POINTS, strict=True))], "series_id string, t long, actual double, predicted double")
    got = conformal.adaptive_intervals(df.repartition(3), **options).orderBy("t").collect()
    assert [(Q(r["quantile"]), r["miss"]) for r in got] == rows and Q(got[-1]["new_quantile"]) == q
    state = conformal.conformal_state(df, **options).first()
    assert (Q(state["quantile"]), state["n_updates"], state["misses"]) == (q, n, misses)
    assert all((r["lower"] is None) == (r["kind"] != "finite") for r in got)


def test_failed_calls_change_nothing():
    t = conformal.AdaptiveConformal()
    with pytest.raises(RuntimeError):
        t.update(1.0)
    t.predict(0.0)
    for bad in (float("nan"), "x", True):
        with pytest.raises(ValueError):
            t.update(bad)
    with pytest.raises(RuntimeError):
        t.predict(0.0)
    assert (t.n, t.quantile) == (0, 0.5) and t.update(0.1)[0] is False
    m = conformal.MultiStepConformal((1, 2))
    m.observe(0, 1.0)
    before = repr(m)
    for bad in (lambda: m.observe(2, 1.0), lambda: m.observe(0, 1.0), lambda: m.observe(1, float("inf")), lambda: m.predict([1.0]), lambda: m.predict([1.0, float("nan")])):
        with pytest.raises(ValueError):
            bad()
    assert repr(m) == before
    for bad in ({"leads": (2, 1)}, {"leads": (1,), "scale_mode": "shortest"}, {"leads": (1,), "share_weights": 0.5}, {"leads": (1, 2), "scales": (1.0,)}):
        with pytest.raises(ValueError):
            conformal.MultiStepConformal(**bad)


@pytest.mark.parametrize("lanes", ["pooled", "interlaced"])
def test_multistep_recursion(spark, lanes):
    leads, steps = (1, 2, 4), (Q(1, 8), Q(1, 16), Q(1, 32))
    state, waiting, want = {}, {}, []
    for t, y in enumerate(ACTUAL):
        for k, origin, q in sorted(waiting.pop(t, [])):
            radius = 2 * q / (1 - q) if 0 <= q < 1 else None
            miss = q < 0 or q < 1 and abs(Q(y) - POINTS[origin]) > radius
            lane = (k, origin % leads[k] if lanes == "interlaced" else 0)
            state[lane] = state.get(lane, Q(1, 2)) + steps[k] * (miss - Q(1, 4))
            want.append((origin, leads[k], q, miss, state[lane]))
        for k, lead in enumerate(leads):
            lane = (k, t % lead if lanes == "interlaced" else 0)
            waiting.setdefault(t + lead, []).append((k, t, state.get(lane, Q(1, 2))))
    series = spark.createDataFrame([("s", t, float(y)) for t, y in enumerate(ACTUAL)], "series_id string, t long, y double")
    points = spark.createDataFrame([("s", t, lead, float(p)) for t, p in enumerate(POINTS) for lead in leads], "series_id string, origin long, lead_time long, predicted double")
    options = {"alpha": 0.25, "step": (0.125, 0.0625, 0.03125), "scales": 2.0, "lanes": lanes}
    got = conformal.multistep_intervals(series, points, leads, options)
    done = got.where("actual is not null").orderBy("target_index", "lead_time").collect()
    assert [(r["origin"], r["lead_time"], Q(r["quantile"]), r["miss"], Q(r["new_quantile"])) for r in done] == want
    assert got.where("actual is null").count() == 1 + 2 + 4
    summary = {r["lead_time"]: r for r in conformal.interval_summary(got, 0.25).collect()}
    assert summary[4]["issued"] == 12 and summary[4]["evaluated"] == 8 and summary[4]["pending"] == 4
    streamed = run_stream(spark, series.join(points.groupBy("series_id", F.col("origin").alias("t")).agg(F.array_sort(F.collect_list(F.struct("lead_time", "predicted")))["predicted"].alias("points")), ["series_id", "t"]), lambda s: online.multistep_stream(s, leads, **options))
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, done))


def run_stream(spark, df, make, files=3):
    import tempfile

    source, target = tempfile.mkdtemp(), tempfile.mkdtemp()
    for i in range(files):  # rows arrive in three micro-batches, shuffled inside each
        df.where(F.col("t") * files >= F.lit(12 * i)).where(F.col("t") * files < F.lit(12 * (i + 1))).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = make(stream).writeStream.format("memory").queryName("streamed").option("checkpointLocation", target).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table("streamed").collect()


@pytest.mark.parametrize("mode", ["horizon", "shortest", "blended"])
def test_scales(mode):
    weights = (0.0, 0.5, 1.0)
    t = conformal.MultiStepConformal((1, 2, 3), scales=(1.0, 2.0, 4.0), scale_mode=mode, scale_decay=0.5, floors=0.5, share_weights=weights if mode == "blended" else None)
    own, source = [1.0, 2.0, 4.0], 1.0
    rng = np.random.default_rng(3)
    points = {}
    for now in range(30):
        y = float(rng.normal())
        t.observe(now, y)
        for k, lead in enumerate((1, 2, 3)):
            if now - lead in points:
                r = abs(y - points[now - lead])
                own[k] = max(0.5, math.sqrt(0.5 * own[k] ** 2 + 0.5 * r * r))
                source = max(0.5, math.sqrt(0.5 * source**2 + 0.5 * r * r)) if k == 0 else source
        if now:
            shared = [max(0.5, source * v) for v in (1, 2, 4)]
            want = {"horizon": own, "shortest": shared, "blended": [(1 - w) * a + w * b for a, b, w in zip(own, shared, weights, strict=True)]}[mode]
            assert t.scales == pytest.approx(want)
        points[now] = float(rng.normal())
        issued = t.predict([points[now]] * 3)
        assert [r[8] for r in issued] == pytest.approx(t.scales)
    bound = {s["lead_time"]: s["coverage_bound"] for s in t.summary()}
    assert bound[1] == pytest.approx(min(1, (1 + 0.05) / (29 * 0.05)))


def test_closure_is_the_minimum_over_subsets():
    rng = np.random.default_rng(1)
    for m in (2, 3, 5):
        e = rng.normal(size=m) * 3
        for i, value in enumerate(sequential.closed(e)):
            best = min(np.log(np.mean([math.exp(e[j]) for j in s])) for k in range(1, m + 1) for s in itertools.combinations(range(m), k) if i in s)
            assert value == pytest.approx(best)


def smcs_rows(spark):
    rng = np.random.default_rng(9)
    rows = []
    for t in range(12):
        y = float(rng.normal())
        f = {"a": y + 0.1, "b": y + 2.0, "c": float(rng.normal())} if t != 4 else {"a": 1.0, "b": 1.0, "c": 1.0}
        rows.append(("s", t, y, f))
    return rows, spark.createDataFrame(rows, "series_id string, t long, actual double, forecasts map<string, double>")


def test_confidence_sets(spark):
    rows, df = smcs_rows(spark)
    for quantile in (None, 0.3):
        options = {"alpha": 0.2, "bet": 0.7, "quantile": quantile}
        fast = sequential.confidence_sets(df.repartition(2), ["a", "b", "c"], **options).orderBy("t", "model_ord").collect()
        slow = sequential.replay(df, ["a", "b", "c"], **options).orderBy("t", "model_ord").collect()
        for a, b in zip(fast, slow, strict=True):
            assert (a["model"], a["t"], a["retained"], a["n_updates"]) == (b["model"], b["t"], b["retained"], b["n_updates"])
            assert (a["log_evalue"], a["log_adjusted"]) == pytest.approx((b["log_evalue"], b["log_adjusted"]))
    wealth = np.zeros((3, 3))
    for _, _, y, f in rows:
        v = list(f.values())
        for i in range(3):
            for j in range(3):
                if v[i] != v[j]:
                    clipped = min(max(y, min(v[i], v[j])), max(v[i], v[j]))
                    wealth[i, j] += math.log1p(0.7 * (abs(clipped - v[i]) - abs(clipped - v[j])) / abs(v[i] - v[j]))
    last = sequential.confidence_sets(df, ["a", "b", "c"], alpha=0.2, bet=0.7).where("t = 11").orderBy("model_ord").collect()
    assert [r["log_evalue"] for r in last] == pytest.approx([math.log(sum(math.exp(wealth[i, j]) for j in range(3) if j != i) / 2) for i in range(3)])
    assert not last[1]["retained"] and last[0]["retained"]
    arrays = df.select("series_id", "t", "actual", F.array(*(F.col("forecasts")[m] for m in "abc")).alias("points"))
    streamed = run_stream(spark, arrays, lambda s: online.confidence_set_stream(s, list("abc"), alpha=0.2, bet=0.7))
    slow = sequential.replay(df, ["a", "b", "c"], alpha=0.2, bet=0.7).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, slow))


def test_overlapping_forecasts_fail(spark):
    test = spark.createDataFrame([("s", o, 2, m, 1.0, 2.0) for o in range(3) for m in "ab"], "series_id string, origin long, lead_time long, model string, actual double, forecast double")
    with pytest.raises(Exception, match="overlap"):
        sequential.sequential_compare(test, 2, ["a", "b"]).collect()


def test_one_step_stream(spark):
    df = spark.createDataFrame([("s", t, float(y), float(p)) for t, (y, p) in enumerate(zip(ACTUAL, POINTS, strict=True))], "series_id string, t long, actual double, predicted double")
    options = {"alpha": 0.25, "step": 0.125, "scale": 2.0}
    got = run_stream(spark, df, lambda s: online.adaptive_stream(s, **options))
    assert sorted(map(tuple, got)) == sorted(map(tuple, conformal.adaptive_intervals(df, **options).collect()))


def test_multistep_queries_take_every_origin(spark, sf):
    from augurline.plans import catalog

    sizes = {r["event_type"]: r["count"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()}
    issued = {(r["series_id"], r["lead_time"]): r["issued"] for r in catalog.queries()["multistep_summary"](spark, sf).collect()}
    assert issued == {(s, lead): n for s, n in sizes.items() for lead in (1, 2, 6)}


def test_multistep_takes_sparse_origins(spark):
    series = spark.createDataFrame([("s", t, float(y)) for t, y in enumerate(ACTUAL)], "series_id string, t long, y double")
    points = spark.createDataFrame([("s", t, lead, float(p)) for t, p in enumerate(POINTS) if t % 2 == 0 for lead in (1, 2)], "series_id string, origin long, lead_time long, predicted double")
    got = conformal.multistep_intervals(series, points, (1, 2), {"alpha": 0.25, "step": 0.125, "scales": 2.0}).collect()
    assert sorted((r["origin"], r["lead_time"]) for r in got) == [(t, lead) for t in range(0, len(POINTS), 2) for lead in (1, 2)]


def resident() -> float:
    """MB of this process."""
    import resource

    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * resource.getpagesize() / 2**20


def test_multistep_holds_a_batch_of_a_long_series(spark, monkeypatch):
    class Watched(conformal.MultiStepConformal):
        def observe(self, time, actual):
            if time == 0:
                self.least = resident()
            if time % 5000 == 0 and resident() - self.least > 100:
                raise MemoryError(f"the replay holds more than 100 MB at {time}")
            return super().observe(time, actual)

    monkeypatch.setattr(conformal, "MultiStepConformal", Watched)
    n, leads = 150_000, (1, 2, 6)
    series = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("t"), F.sin(F.col("id") * 0.7).alias("y"))
    points = series.select("series_id", F.col("t").alias("origin"), F.explode(F.array(*(F.lit(v).cast("long") for v in leads))).alias("lead_time"), F.col("y").alias("predicted"))
    rows = conformal.multistep_intervals(series, points, leads, {"decay": 0.5})
    got = {r["lead_time"]: r for r in conformal.interval_summary(rows, 0.1, {"decay": 0.5}).collect()}
    assert {lead: (r["issued"], r["evaluated"], r["pending"]) for lead, r in got.items()} == {lead: (n, n - lead, lead) for lead in leads}


def test_summary_replays_once(spark):
    series = spark.createDataFrame([("s", t, float(y)) for t, y in enumerate(ACTUAL)], "series_id string, t long, y double")
    points = series.selectExpr("series_id", "t as origin", "explode(array(1L, 20L)) as lead_time", "y as predicted")
    for lanes in ("pooled", "interlaced"):
        rules = {"step": 0.2, "decay": 0.4, "lanes": lanes}
        summary = conformal.interval_summary(conformal.multistep_intervals(series, points, (1, 20), rules), 0.1, rules)
        assert summary._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
        late = {r["lead_time"]: r for r in summary.collect()}[20]
        assert (late["issued"], late["evaluated"], late["score_status"]) == (12, 0, "no feedback")
        assert late["coverage"] is None and late["coverage_bound"] is None and late["mean_interval_score"] is None
