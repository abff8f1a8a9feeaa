"""Times and sizes of a hop log, and a log that only shows whole batches."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from waybill.functions.route import make_route
from waybill.operators import metrics as M
from waybill.operators.actors import Registry
from waybill.operators.hops import hop_log, run
from waybill.session import scratch
from waybill.sources.hoplog import read_log
from waybill.sources.queues import read_queue, write_routed
from waybill.streaming.hops import run_actor_stream

OLD = datetime(2024, 1, 1)


def envelopes(spark, n=6, actors=("slow", "plain")):
    rows = spark.createDataFrame([(f"e{i}", OLD + timedelta(minutes=i), "a" * i) for i in range(n)],
                                 "id string, enqueued_at timestamp, payload string")
    payload = F.to_json(F.struct(F.col("payload").alias("t")))
    return rows.select("id", make_route(F.array(*map(F.lit, actors))).alias("route"),
                       payload.alias("payload"), "enqueued_at")


def registry():
    reg = Registry()

    @reg.actor("slow")
    def slow(p):
        import time

        time.sleep(0.02)
        return [p, p] if p["t"] == "aa" else p

    reg.column_actor("plain", lambda p: F.concat(p, F.lit(" ")))
    return reg


def test_every_hop_has_its_times(spark):
    done = run(envelopes(spark), registry(), max_hops=2).cache()
    log = {(r.id, r.actor): r for r in hop_log(done).filter("pos = 0").collect()}
    for i in range(6):
        first, second = log[f"e{i}", "slow"], log[f"e{i}", "plain"]
        assert first.enqueued_at == OLD + timedelta(minutes=i) < first.started_at
        assert first.duration_s >= 0.02 and second.duration_s is None
        end = first.started_at + timedelta(seconds=first.duration_s)
        assert abs(second.enqueued_at - end) < timedelta(milliseconds=1)
        assert second.started_at >= second.enqueued_at
    assert (log["e2-1", "plain"].enqueued_at, log["e2-1", "plain"].parent_id) == (
        log["e2", "plain"].enqueued_at, "e2")
    rows = M.from_run(done)
    last = M.queue_depth_runs(rows, seconds=60).groupBy("queue").agg(
        F.max("queued").alias("peak"), F.max_by("queued", "start").alias("left")).collect()
    assert {r.queue: (r.peak, r.left) for r in last}["slow"] == (6, 0)
    got = {(r.queue, r.direction): r["count"] for r in M.size_histograms(rows).collect()}
    assert got == {("slow", "received"): 6, ("slow", "sent"): 7, ("plain", "received"): 7,
                   ("plain", "sent"): 7}
    times = {(r.queue, r.time): (r["count"], r.sum) for r in M.time_histograms(rows).collect()}
    assert times["slow", "runtime"][0] == 6 and times["slow", "runtime"][1] >= 0.12
    assert times["slow", "receive"][1] > 86400 and times["plain", "runtime"] == (0, None)


def test_typed_payloads_are_measured_on_request(spark):
    env = envelopes(spark).withColumn("payload", F.struct(F.lit(7).alias("n")))
    reg = Registry()
    reg.column_actor("slow", lambda p: p.withField("n", p["n"] * 100))
    reg.column_actor("plain", lambda p: p)
    log = hop_log(run(env, reg, max_hops=2, sizes=True)).select("actor", "size_in", "size_out")
    assert {tuple(r) for r in log.collect()} == {("slow", 7, 9), ("plain", 9, 9)}
    assert hop_log(run(env, reg, max_hops=2)).filter("size_in IS NOT NULL").isEmpty()


def test_actor_streams_log_whole_batches(spark):
    queues, log = scratch(spark, "queues"), scratch(spark, "log")
    for k in range(2):
        part = envelopes(spark).filter(F.col("id").isin(*[f"e{i}" for i in range(6) if i % 2 == k]))
        write_routed(part.drop("enqueued_at").withColumns({
            "dest": F.lit("slow"), "parent_id": F.lit(None).cast("string"),
            "headers": F.lit(None).cast("map<string,string>")}), queues, batch=f"b{k}")
    for actor in ("slow", "plain"):
        run_actor_stream(spark, queues, actor, registry(), scratch(spark, "check"), max_files=1,
                         log=log, on_collision="hop").awaitTermination()
    rows = read_log(spark, log).cache()
    got = {(r.queue, r.id, r.hop, r.pos) for r in rows.collect()}
    assert got == ({("slow", f"e{i}", 1, 0) for i in range(6)} | {("slow", "e2", 1, 1)}
                   | {("plain", f"e{i}", 2, 0) for i in range(6)} | {("plain", "e2-h1-1", 2, 0)})
    for r in rows.filter("pos = 0").collect():
        assert r.enqueued_at <= r.started_at <= r.called_at <= r.ended_at
        assert r.send_s <= r.processing_s and r.receive_s >= 0
    assert read_queue(spark, queues, "happy-end").filter("hop = 2").count() == 7
    # a batch without its last row never ended, and does not show
    place = f"{log}/batches/actor=plain"
    kept = spark.read.parquet(place).filter("batch > 0").drop("actor")
    path = scratch(spark, "other")
    spark.read.parquet(f"{log}/rows").write.partitionBy("actor", "batch").parquet(f"{path}/rows")
    whole = spark.read.parquet(f"{log}/batches")
    (whole.filter("actor = 'slow' OR batch > 0").write.partitionBy("actor", "batch")
     .parquet(f"{path}/batches"))
    gone = spark.read.parquet(f"{log}/batches").filter("actor = 'plain' AND batch = 0").first().n
    assert read_log(spark, path).count() == rows.count() - gone and kept.count() >= 1
