from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from waybill.operators import delivery as D
from waybill.operators import lineage as L
from waybill.operators import status as S
from waybill.operators.scan import seq_chunk
from waybill.schema import UPDATE

T0 = datetime(2024, 1, 1)


def envs(spark, *rows):
    data = [(i, a, T0, t) for i, a, t in rows]
    df = spark.createDataFrame(
        data, "id string, actors array<string>, created_at timestamp, timeout_sec int")
    return S.with_deadline(df)


def log(spark, rows):
    """Rows of dicts; seq and ts follow the position."""
    names = [f.name for f in UPDATE.fields]
    data = []
    for i, r in enumerate(rows):
        full = {"envelope_id": "e", "seq": i, "status": "running",
                "ts": T0 + timedelta(seconds=i)} | r
        data.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(data, UPDATE)


def reports(*pairs, actors=None):
    return [{"current_actor_idx": i, "envelope_state": s, "actors": actors} for i, s in pairs]


STATES = ("received", "processing", "completed")


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_progress_of_three_actors(spark, width):
    upd = log(spark, reports(*[(i, s) for i in range(3) for s in STATES]))
    got = S.progress(envs(spark, ("e", ["a", "b", "c"], 0)), upd, width).orderBy("seq")
    assert [r.progress for r in got.collect()] == [
        3.33, 16.67, 33.33, 36.67, 50.0, 66.67, 70.0, 83.33, 100.0]


def test_empty_reported_route_uses_the_stored_one(spark):
    upd = log(spark, reports((1, "processing"), actors=[]))
    assert S.progress(envs(spark, ("e", ["a", "b", "c"], 0)), upd).first().progress == 50.0


@pytest.mark.parametrize("width", [1, 1000])
def test_growing_route_never_lowers_progress(spark, width):
    rows = reports((0, "completed"), actors=["a", "b"])
    rows += reports((1, "received"), actors=["a", "b", "c"])
    rows += reports((1, "processing"), (1, "completed"), actors=list("abcde"))
    got = S.progress(envs(spark, ("e", ["a", "b"], 0)), log(spark, rows), width).orderBy("seq")
    assert [r.progress for r in got.collect()] == [50.0, 50.0, 50.0, 50.0]
    routes = S.route_asof(envs(spark, ("e", ["a", "b"], 0)), log(spark, rows), width)
    assert [len(r.route_actors) for r in routes.orderBy("seq").collect()] == [2, 3, 5, 5]


@pytest.mark.parametrize("width", [1, 1000])
def test_fold(spark, width):
    rows = reports((0, "received"), (0, "completed"), (1, "completed"))
    rows[0]["message"] = "first"
    rows += [{"status": "failed", "error": "broke", "result": "r", "current_actor_idx": 1},
             {"status": "running", "message": "late", "current_actor_idx": 0},
             {"status": "succeeded", "result": "no"},
             {"envelope_id": "ghost"}]
    frame = envs(spark, ("e", ["a", "b"], 60), ("quiet", ["a"], 0))
    got = {r.id: r for r in S.fold_status(frame, log(spark, rows), width).collect()}
    e, quiet = got["e"], got["quiet"]
    assert set(got) == {"e", "quiet"}
    assert (e.status, e.error, e.result, e.message) == ("failed", "broke", "r", "first")
    assert (e.current_actor_idx, e.current_actor_name) == (1, "b")
    assert (e.progress_percent, e.actors_completed, e.total_actors) == (100.0, 2, 2)
    assert e.updated_at == T0 + timedelta(seconds=3) and e.n_updates == 4
    assert (quiet.status, quiet.progress_percent, quiet.total_actors) == ("pending", 0.0, 1)
    late = S.progress(frame, log(spark, rows), width).filter("late")
    assert sorted(r.seq for r in late.collect()) == [4, 5]
    ghosts = S.orphan_updates(frame, log(spark, rows)).collect()
    assert [r.envelope_id for r in ghosts] == ["ghost"]


def test_active_and_timeouts(spark):
    rows = [{"envelope_id": "run"}, {"envelope_id": "done", "status": "succeeded"}]
    frame = envs(spark, ("run", ["a"], 60), ("done", ["a"], 60), ("open", ["a"], 0),
                 ("new", ["a"], 600))
    snap = S.fold_status(frame, log(spark, rows))
    now = F.lit("2024-01-01 00:02:00").cast("timestamp")
    active = snap.select("id", S.is_active(F.col("status"), F.col("deadline"), now).alias("a"))
    assert {r.id: r.a for r in active.collect()} == {
        "run": False, "done": False, "open": True, "new": True}
    expired = S.timeouts(snap, now).collect()
    assert [(r.envelope_id, r.status, r.error) for r in expired] == [
        ("run", "failed", "envelope timed out")]


def test_history_and_since(spark):
    upd = log(spark, [{}, {}, {}])
    rows = S.history(upd).orderBy("position").collect()
    assert [(r.position, r.seq) for r in rows] == [(1, 0), (2, 1), (3, 2)]
    later = S.updates_since(upd, "e", T0 + timedelta(seconds=1)).collect()
    assert [r.seq for r in later] == [2]


def test_retention_keeps_open_and_fresh(spark):
    rows = [{"envelope_id": "old", "status": "succeeded"}, {"envelope_id": "open"},
            {"envelope_id": "new", "status": "failed", "ts": T0 + timedelta(days=9)},
            {"envelope_id": "new", "ts": T0}]
    upd = log(spark, rows)
    snap = S.fold_status(envs(spark, ("old", ["a"], 0), ("open", ["a"], 0), ("new", ["a"], 0)), upd)
    kept = S.retain(upd, snap, T0 + timedelta(days=1)).collect()
    assert sorted((r.envelope_id, r.seq) for r in kept) == [("new", 2), ("new", 3), ("open", 1)]


def test_family_of_deep_chain_cycle_and_missing_parent(spark):
    rows = [("r", None)] + [(f"c{i}", "r" if i == 0 else f"c{i - 1}") for i in range(13)]
    rows += [("x", "y"), ("y", "x"), ("lost", "gone")]
    got = {r.id: (r.root, r.depth) for r in
           L.family(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert len(got) == len(rows)
    assert all(got[f"c{i}"] == ("r", i + 1) for i in range(13))
    assert got["r"] == ("r", 0) and got["lost"] == ("gone", 1)
    assert got["x"][0] is None and got["y"][0] is None


def test_duplicates_of_store_and_batch(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "id string, seq bigint")
    stored = spark.createDataFrame([("b",), ("b",)], "id string")
    good, bad = L.reject_duplicates(new, stored, "seq", seq_chunk("seq", 2))
    assert sorted(map(tuple, good.collect())) == [("a", 1), ("c", 4)]
    assert sorted(map(tuple, bad.collect())) == [("a", 2), ("b", 3)]


def test_attempts_redelivery_and_dead_letters(spark):
    rows = [("p", i, "nack") for i in range(5)] + [("q", 9, "nack"), ("q", 10, "ack")]
    tries = D.attempts(spark.createDataFrame(rows, "id string, seq bigint, outcome string"))
    targets = [r.target for r in D.redrive(tries).filter("id = 'p'").orderBy("seq").collect()]
    assert targets == ["queue"] * 3 + ["dead-letter"] * 2
    assert [tuple(r) for r in D.redeliverable(tries).collect()] == [("p", 5)]


def test_fold_resumes_from_its_own_result(spark):
    rows = reports(*[(i, s) for i in range(3) for s in STATES], actors=["a", "b", "c"])
    rows[4]["message"] = "half"
    rows += [{"status": "succeeded", "result": "r"}, {"current_actor_idx": 0, "message": "late"}]
    frame = envs(spark, ("e", ["a", "b"], 60), ("quiet", ["z"], 0))
    upd = log(spark, rows)
    whole = S.fold_status(frame, upd).orderBy("id").collect()
    for cut in (0, 3, 5, 9, 10):
        first = S.fold_status(frame, upd.filter(F.col("seq") < cut))
        second = S.fold_status(first, upd.filter(F.col("seq") >= cut))
        assert second.orderBy("id").collect() == whole, cut
