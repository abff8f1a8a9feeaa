import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.functions.text import metric_name, size_kb_message
from waybill.operators import metrics as M

T0 = datetime(2024, 1, 1)


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("q", v) for v in (0.5, 1.0, 3.0, 99.0)], "queue string, v double")
    rows = M.histogram(df, "v", ["queue"], (1.0, 5.0)).collect()
    assert [(r.le, r.n, r["count"], r["sum"]) for r in rows] == [
        ("1", 2, 4, 103.5), ("5", 3, 4, 103.5), ("+Inf", 4, 4, 103.5)]


def test_bucket_quantile(spark):
    df = spark.createDataFrame([("q", v) for v in (0.5, 0.6, 2.0, 4.0)], "queue string, v double")
    hist = M.histogram(df, "v", ["queue"], (1.0, 5.0))
    assert M.histogram_quantile(hist, ["queue"], 0.75).first()["quantile"] == pytest.approx(3.0)
    over = M.histogram(df, "v", ["queue"], (0.1, 1.0))
    assert M.histogram_quantile(over, ["queue"], 0.99).first()["quantile"] == 1.0


def test_depth_equals_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(80):
        a = T0 + timedelta(seconds=rng.randrange(3000))
        b = a + timedelta(seconds=rng.randrange(900))
        c = None if rng.random() < 0.2 else b + timedelta(seconds=rng.randrange(900))
        rows.append((rng.choice("xy"), a, b, c))
    df = spark.createDataFrame(
        rows, "queue string, enqueued_at timestamp, started_at timestamp, ended_at timestamp")
    got = M.queue_depth(df, seconds=60).collect()
    assert len(got) > 50
    for r in got:
        mine = [x for x in rows if x[0] == r.queue]
        assert r.queued == sum(a <= r["at"] < b for _, a, b, _ in mine)
        assert r.processing == sum(b <= r["at"] and (c is None or c > r["at"])
                                   for _, _, b, c in mine)


def test_a_stray_time_costs_a_row(spark):
    far = datetime(9999, 12, 1)
    rows = [("x", T0, T0 + timedelta(minutes=5), far), ("x", T0, T0 + timedelta(minutes=7), None)]
    df = spark.createDataFrame(
        rows, "queue string, enqueued_at timestamp, started_at timestamp, ended_at timestamp")
    got = M.queue_depth_runs(df, seconds=60).orderBy("start").collect()
    assert [(r.start, r.end, r.queued, r.processing) for r in got] == [
        (T0, T0 + timedelta(minutes=5), 2, 0),
        (T0 + timedelta(minutes=5), T0 + timedelta(minutes=7), 1, 1),
        (T0 + timedelta(minutes=7), far, 0, 2), (far, None, 0, 1)]
    quick = M.Thresholds(depth=1, depth_for=120)
    log = df.withColumns({"pos": F.lit(0), "outcome": F.lit("success"), "duration_s": F.lit(1.0),
                          "error_type": F.lit(None).cast("string")})
    assert {(r.alert, r["at"], r.value) for r in M.alerts(log, quick).collect()} == {
        ("queue_depth", T0 + timedelta(minutes=m), 2.0) for m in (1, 2, 3, 4)}


def plain_alerts(rows, lim, window=300, slide=60):
    """rows: (queue, pos, outcome, error_type, duration, enqueued, started, ended), in seconds."""
    out = set()
    for queue in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == queue]
        starts = {r[6] // slide * slide - k * slide for r in mine for k in range(window // slide)}
        inside = {s: [r for r in mine if s <= r[6] // slide * slide < s + window] for s in starts}
        share = {}
        for s, held in inside.items():
            n = sum(r[1] == 0 for r in held)
            bad = sum(r[1] == 0 and r[2] in M.FAILED for r in held)
            share[s] = bad / n if n else None
            broken = sum(r[1] == 0 and r[3] == "execution_error" for r in held) / window
            if broken > lim.runtime_error_rate:
                out.add(("runtime_errors", queue, s, round(broken, 6)))
        on = {s for s, x in share.items() if x is not None and x > lim.error_ratio}
        for s in starts:
            if all(s - k * slide in on for k in range(lim.error_for // slide)):
                out.add(("high_error_ratio", queue, s, round(share[s], 6)))
        for s in {r[6] // window * window for r in mine}:
            times = [r[4] for r in mine if r[6] // window * window == s and r[1] == 0 and r[4] is not None]
            if times and np.quantile(times, 0.95) > lim.p95_seconds:
                out.add(("slow_processing", queue, s, round(float(np.quantile(times, 0.95)), 6)))
        ends = [x for r in mine for x in r[5:8] if x is not None]
        grid = range(-(-min(ends) // slide) * slide, -(-max(ends) // slide) * slide + 1, slide)
        depth = {t: sum(r[5] <= t < r[6] for r in mine) for t in grid}
        for t in grid:
            if all(depth.get(t - k * slide, 0) > lim.depth for k in range(lim.depth_for // slide)):
                out.add(("queue_depth", queue, t, float(depth[t])))
    return out


def test_alerts_equal_plain_version(spark):
    rng, rows = random.Random(4), []
    for _ in range(700):
        enqueued = rng.randrange(100, 9000)
        started = enqueued + rng.randrange(0, 900)
        outcome = rng.choice(["success", "runtime_error", "success"])
        rows.append((
            rng.choice("xyyy"), rng.choice([0, 0, 1]), outcome,
            rng.choice(["execution_error", None]) if outcome != "success" else None,
            rng.choice([None, 1.0, 2.0, 5.0, round(rng.expovariate(0.2), 3)]), enqueued, started,
            rng.choice([None, started + rng.randrange(600)])))
    df = spark.createDataFrame(
        rows, "queue string, pos int, outcome string, error_type string, duration_s double, "
        "enqueued_at long, started_at long, ended_at long")
    for c in ("enqueued_at", "started_at", "ended_at"):
        df = df.withColumn(c, F.timestamp_seconds(c))
    lim = M.Thresholds(error_ratio=0.3, error_for=180, depth=20, depth_for=240, p95_seconds=8.0,
                       runtime_error_rate=0.01)
    out = M.alerts(df, lim).withColumn("at", F.unix_seconds("at"))
    got = [(r.alert, r.queue, r["at"], round(r.value, 6)) for r in out.collect()]
    want = plain_alerts(rows, lim)
    assert {x[0] for x in want} == {"runtime_errors", "high_error_ratio", "slow_processing", "queue_depth"}
    assert len(got) == len(set(got)) and set(got) == want


def test_capacity_is_clamped(spark):
    depth = spark.createDataFrame([(0, 0), (11, 1), (999, 0)], "queued bigint, processing bigint")
    got = M.capacity(depth, target=5, low=1, high=10).collect()
    assert [r.workers for r in got] == [1, 3, 10]


def test_rate_windows(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=s),) for s in (0, 59, 60, 299)], "ts timestamp")
    rows = M.rate(df.withColumn("queue", F.lit("q")), "ts", ["queue"]).collect()
    got = {r.window_start: r.n for r in rows}
    assert got[T0] == 4 and got[T0 - timedelta(minutes=4)] == 2
    assert got[T0 + timedelta(minutes=1)] == 2 and got[T0 + timedelta(minutes=4)] == 1


def test_held_for_needs_every_step(spark):
    flags = [(60 * i, f) for i, f in enumerate([1, 1, 1, 0, 1, 1])] + [(60 * 7, 1), (60 * 8, 1)]
    df = spark.createDataFrame([("q", s, bool(f)) for s, f in flags],
                               "queue string, start bigint, hit boolean")
    held = M.held_for(df, ["queue"], "hit", 60, 180).collect()
    assert [r.start for r in held] == [120]


@pytest.mark.parametrize("raw,clean", [("a.b-c d", "a_b_c_d"), ("9lives", "_9lives"), ("ok:1", "ok:1")])
def test_metric_names(spark, raw, clean):
    assert spark.range(1).select(metric_name(F.lit(raw))).first()[0] == clean


def test_custom_metric_kinds(spark):
    df = spark.createDataFrame([("q", 1.0, 1), ("q", 4.0, 2)], "queue string, v double, ts int")
    total = M.custom_metric(df, M.MetricSpec("n", "Counter", ("queue",), "v")).first()
    last = M.custom_metric(df, M.MetricSpec("g", "gauge", ("queue",), "v")).first()
    hist = M.custom_metric(df, M.MetricSpec("h", "histogram", ("queue",), "v")).collect()
    assert (total.value, last.value, len(hist)) == (5.0, 4.0, len(M.DEFAULT_BUCKETS) + 1)
    with pytest.raises(ValueError):
        M.custom_metric(df, M.MetricSpec("x", "summary"))


def test_size_message_rounds_like_c(spark):
    got = spark.createDataFrame([(1152,), (640,), (1536,)], "n bigint").select(
        size_kb_message(F.col("n")))
    assert [r[0] for r in got.collect()] == [
        "Received message (1.12 KB)", "Received message (0.62 KB)", "Received message (1.50 KB)"]
