import random
from contextlib import contextmanager
from datetime import datetime, timedelta
from pathlib import Path
from unittest.mock import Mock, patch

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.functions.route import make_route
from waybill.operators import status as S
from waybill.plans import streams
from waybill.schema import DETAILS, UPDATE
from waybill.session import scratch
from waybill.sources import results
from waybill.sources.results import read_terminal, write_terminal
from waybill.sources.slots import StateTable
from waybill.sources.state import stream_updates
from waybill.streaming.processors import StatusFold
from waybill.streaming.status import (STATUS, read_status, run_attempts_stream, run_dedup_stream,
                                      run_status_stream)

T0 = datetime(2024, 1, 1)
SCHEMA = T.StructType([*UPDATE.fields, T.StructField("deadline", T.TimestampType())])


def files(spark, path, *batches):
    """One parquet file per batch, in order of time."""
    names = SCHEMA.fieldNames()
    for rows in batches:
        data = [tuple(r.get(n) for n in names) for r in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_status_table_over_many_batches(spark):
    path, table = scratch(spark, "log"), scratch(spark, "table")
    at = lambda s: T0 + timedelta(seconds=s)
    made = lambda i, due: {"envelope_id": i, "seq": -1, "actors": ["a", "b"], "ts": at(0),
                           "deadline": at(due)}
    report = lambda i, s, idx, state, t: {"envelope_id": i, "seq": s, "status": "running",
                                          "current_actor_idx": idx, "envelope_state": state,
                                          "ts": at(t)}
    files(spark, path, [made("x", 90), made("y", 500), report("x", 1, 0, "completed", 1)])
    files(spark, path, [report("x", 2, 0, "received", 20), report("y", 3, 1, "received", 21),
                        made("y", 9)])
    files(spark, path, [{"envelope_id": "y", "seq": 4, "status": "succeeded", "result": "ok",
                         "ts": at(100)}, report("ghost", 5, 0, "received", 100)])
    files(spark, path, [report("y", 6, 0, "received", 120), made("z", 900)])
    checkpoint = scratch(spark, "checkpoint")
    stream = stream_updates(spark, path, SCHEMA, max_files=1)
    run_status_stream(stream, table, checkpoint).awaitTermination()
    got = {r.id: r for r in read_status(spark, table).collect()}
    assert set(got) == {"x", "y", "z"}
    assert (got["x"].status, got["x"].error) == ("failed", "envelope timed out")
    assert (got["y"].status, got["y"].result, got["y"].progress_percent) == ("succeeded", "ok", 100)
    assert (got["z"].status, got["z"].total_actors) == ("pending", 2)
    assert got["x"].n_updates == 2 and got["x"].completed == [0]
    table = StateTable(spark, table, STATUS)
    assert [r.id for r in table.open().collect()] == ["z"] and table.closed().count() == 2
    assert S.status_counts(table.read()).agg(F.sum("n")).first()[0] == 3


def test_created_again(spark):
    """The first creation counts: in one batch, of an open envelope, and of a closed one."""
    path, table = scratch(spark, "log"), scratch(spark, "table")
    at = lambda s: T0 + timedelta(seconds=s)
    made = lambda i, t, n: {"envelope_id": i, "seq": -1, "actors": ["a"] * n, "ts": at(t)}
    done = lambda i, s, t, r: {"envelope_id": i, "seq": s, "status": "succeeded", "result": r,
                               "ts": at(t)}
    files(spark, path, [made("x", 5, 3), made("x", 1, 2), made("y", 2, 1)])
    files(spark, path, [made("y", 6, 4), done("x", 1, 7, "first")])
    files(spark, path, [made("x", 8, 5), done("x", 2, 9, "second"), made("w", 9, 1)])
    files(spark, path, [made("x", 10, 6)])
    stream = stream_updates(spark, path, SCHEMA, max_files=1)
    run_status_stream(stream, table, scratch(spark, "checkpoint"), compact=2).awaitTermination()
    got = {r.id: r for r in read_status(spark, table).collect()}
    assert len(got) == read_status(spark, table).count() == 3
    assert (got["x"].result, got["x"].total_actors, got["x"].created_at) == ("first", 2, at(1))
    assert (got["y"].status, got["y"].total_actors) == ("pending", 1)


SMALL = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])


def folder_bytes(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_state_table_against_a_dictionary(spark):
    """Random changes, closings and repeated versions; the folder does not grow with versions."""
    rng, path = random.Random(2), scratch(spark, "state")
    table = StateTable(spark, path, SMALL, compact=3)
    frame = lambda d: spark.createDataFrame(sorted(d.items()), SMALL).coalesce(1)
    state, ended, sizes = {}, {}, []
    for version in range(14):
        changed = {f"k{rng.randrange(8)}": version for _ in range(4)}
        changed = {k: v for k, v in changed.items() if k not in ended}
        gone = {k: v for k, v in state.items() if k not in changed and rng.random() < 0.1}
        if version in (4, 9):  # an attempt that fails before its line is written
            with monkeypatched(table, "line", lambda before=None: line_of(path, spark, version)):
                frame({"wrong": -1}).select("*", F.lit(False).alias("__gone"), F.lit(version).cast(
                    "bigint").alias("__version")).write.mode("overwrite").parquet(
                    f"{path}/open{table.line().slot}/part={version}")
            assert {r.id: r.v for r in table.open().collect()} == state
        for _ in range(2 if version in (3, 6, 7) else 1):  # a repeat replaces its own files
            table.commit(version, frame(changed), frame(gone), frame(gone).select("id"))
        state = {k: v for k, v in {**state, **changed}.items() if k not in gone}
        ended.update(gone)
        assert {r.id: r.v for r in table.open().collect()} == state
        assert {r.id: r.v for r in table.read().collect()} == {**state, **ended}
        sizes.append(folder_bytes(f"{path}/open0") + folder_bytes(f"{path}/open1"))
    assert max(sizes[7:]) <= 1.5 * max(sizes[:7]) and table.line().version == 13


def line_of(path, spark, version):
    return StateTable(spark, path, SMALL, compact=3).line(version)


@contextmanager
def monkeypatched(thing, name, value):
    setattr(thing, name, value)
    try:
        yield
    finally:
        delattr(thing, name)


def test_attempts_and_dedup_over_batches(spark):
    path = scratch(spark, "deliveries")
    rng, order, batches = random.Random(3), [], []
    for k in (2, 0, 1, 3):
        rows = [(rng.choice(["hot", "hot", "hot", "a", None]), 1000 * k + i) for i in range(40)]
        rng.shuffle(rows)
        batches.append(rows)
        spark.createDataFrame(rows, "id string, seq long").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema("id string, seq long").option(
        "maxFilesPerTrigger", "1").parquet(path)
    out, want, n = scratch(spark, "attempts"), {}, {}
    keyed = stream().filter("id IS NOT NULL")
    run_attempts_stream(keyed, out, scratch(spark, "check"), compact=1).awaitTermination()
    for rows in batches:
        for key, seq in sorted((r for r in rows if r[0]), key=lambda r: r[1]):
            n[key] = n.get(key, 0) + 1
            want[key, seq] = n[key]
    got = spark.read.parquet(f"{out}/rows").collect()
    assert {(r.id, r.seq): r.attempt for r in got} == want and len(got) == len(want)
    kept = scratch(spark, "dedup")
    run_dedup_stream(stream(), kept, scratch(spark, "check"), keys=("id",)).awaitTermination()
    rows = spark.read.parquet(kept).collect()
    assert sorted((r.id or "") for r in rows) == ["", "a", "hot"] and {r.batch for r in rows} == {0}


def test_repeated_writes_and_lookups(spark):
    base, at = scratch(spark, "terminals"), datetime(2024, 5, 1, 10)
    rows = [(f"e{i}", at + timedelta(hours=i % 5), "happy-end", "tag") for i in range(50)]
    done = spark.createDataFrame(rows, "id string, finished_at timestamp, terminal string, last_actor string")
    done = done.withColumns({
        "parent_id": F.lit(None).cast("string"), "headers": F.lit(None).cast("map<string,string>"),
        "route": make_route(F.array(F.lit("tag"))), "payload": F.lit("{}"),
        "error": F.lit(None).cast("string"), "details": F.lit(None).cast(DETAILS)})
    for shift in (0, 24):
        later = done.withColumn("finished_at", F.col("finished_at") + F.expr(f"INTERVAL {shift} HOURS"))
        write_terminal(later, base, batch="1", index=True)
    write_terminal(done.filter("id < 'e2'").withColumn("id", F.concat(F.lit("f"), "id")), base,
                   batch="2", index=True)
    assert read_terminal(spark, base).count() == 50 + done.filter("id < 'e2'").count()
    one = read_terminal(spark, base, id="e7", index=True)
    assert [(r.id, r.hour) for r in one.collect()] == [("e7", 12)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("],")[0]
    assert "hour" in filters and "date" in filters and "batch" in filters
    assert read_terminal(spark, base, prefix="e1", index=True).count() == 11
    assert read_terminal(spark, base, id="nobody", index=True).count() == 0
    assert read_terminal(spark, base, prefix="fe", terminal="happy-end", index=True).count() == 12
    with patch.object(results, "FOLDERS", 1):  # more folders than are named one by one
        assert read_terminal(spark, base, prefix="e1", index=True).count() == 11


def test_lookup_in_hundreds_of_folders(spark):
    """Each id in an hour of its own: the folders are named in the plan, and it stays flat."""
    base, at = scratch(spark, "terminals"), datetime(2024, 5, 1)
    done = spark.range(700).select(
        F.concat(F.lit("e"), F.col("id")).alias("id"),
        (F.lit(at) + F.make_interval(hours=F.col("id").cast("int"))).alias("finished_at"),
        F.lit("happy-end").alias("terminal"), F.lit("tag").alias("last_actor"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        make_route(F.array(F.lit("tag"))).alias("route"), F.lit("{}").alias("payload"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast(DETAILS).alias("details"))
    write_terminal(done.coalesce(1), base, batch="1", index=True)
    many = read_terminal(spark, base, prefix="e", index=True)
    assert {r.id for r in many.collect()} == {f"e{i}" for i in range(700)}
    some = read_terminal(spark, base, prefix="e1", index=True)
    assert some.count() == 111
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "hour" in plan.split("PartitionFilters: [")[1].split("],")[0]


def ended(rows):
    """Terminal rows of (id, time, actor)."""
    return rows.toDF("id", "finished_at", "last_actor").select(
        "*", F.when(F.col("id") > "e5", "error-end").otherwise("happy-end").alias("terminal"),
        F.lit(None).cast("string").alias("parent_id"),
        F.create_map(F.lit("k"), F.col("id")).alias("headers"),
        make_route(F.array(F.lit("tag"))).alias("route"),
        F.to_json(F.struct("id", F.lit("line\n\u00fc").alias("text"))).alias("payload"),
        F.lit("broken").alias("error"), F.lit(None).cast(DETAILS).alias("details"))


def test_indexed_writes_are_those_of_spark(spark):
    """Folders made by the workers: the same names and lines as Spark's, without a process each."""
    at = datetime(2024, 5, 1, 10)
    actors = ["tag", "", None, "a/b", "x=1", "50% {of}", "two words"]
    rows = [(f"e{i}", None if i == 4 else at + timedelta(hours=i % 3), actors[i % 7])
            for i in range(80)] + [(None, at, "tag"), ("e1", at, "tag"), ("e1", at, "tag")]
    done = ended(spark.createDataFrame(rows, "id string, finished_at timestamp, last_actor string"))
    plain, base = scratch(spark, "terminals"), scratch(spark, "terminals")
    write_terminal(done, plain, batch="01")
    for compact in (False, True):  # the second replaces the first
        write_terminal(done, base, batch="01", index=True, compact=compact)

    def lines(place):
        at = Path(place, "batch=01")
        return sorted((str(f.parent.relative_to(at)), line) for f in at.rglob("*.json")
                      for line in f.read_bytes().splitlines())

    assert lines(base) == lines(plain) and len(lines(base)) == len(rows)
    assert sorted(p.name for p in Path(base).iterdir()) == ["batch=01"]
    assert Path(base, "batch=01", "_SUCCESS").exists() and not [*Path(base).rglob("*.crc")]
    for i in range(1, 8):
        want = read_terminal(spark, plain, id=f"e{i}").drop("batch").collect()
        assert read_terminal(spark, base, id=f"e{i}", index=True).collect() == want and want
    there = scratch(spark, "terminals")
    with patch.object(results, "local_path", return_value=None):  # as on any other file system
        write_terminal(done, there, batch="01", index=True)
    kept = [spark.read.parquet(f"{at}-index").collect() for at in (base, there)]
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1])) and len(kept[0]) == len(rows)
    write_terminal(done.filter("false"), base, batch="01", index=True)
    assert not lines(base) and read_terminal(spark, base, id="e1", index=True).count() == 0


def test_a_folder_over_many_batches_is_one_file(spark):
    rows = spark.range(25_000, numPartitions=1).select(
        F.concat(F.lit("e"), "id"), F.timestamp_seconds(F.col("id") % 2 * 3600), F.lit("tag"))
    base = scratch(spark, "terminals")
    write_terminal(ended(rows).withColumn("terminal", F.lit("happy-end")), base, batch="1", index=True)
    stored = read_terminal(spark, base)
    assert len(stored.inputFiles()) == 2
    assert stored.select("id", "payload").distinct().count() == stored.count() == 25_000


def test_folders_beyond_ascii_and_failed_writes(spark):
    """Which bytes such a name becomes is Spark's business; a failure leaves what was there."""
    at = datetime(2024, 5, 1, 10)
    rows = [(f"e{i}", at, "\u00fcber" if i % 2 else "tag") for i in range(9)]
    done = ended(spark.createDataFrame(rows, "id string, finished_at timestamp, last_actor string"))
    base = scratch(spark, "terminals")
    write_terminal(done, base, batch="1", index=True)
    assert {r.id for r in read_terminal(spark, base).collect()} == {f"e{i}" for i in range(9)}
    broken = done.withColumn("payload", F.when(F.col("id") == "e7", F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        write_terminal(broken, base, batch="1", index=True)
    assert read_terminal(spark, base).count() == 9
    assert sorted(p.name for p in Path(base).iterdir()) == ["batch=1"]


def test_lookup_lists_its_folders_only(spark):
    at = datetime(2024, 5, 1)
    rows = [(f"e{i}", at + timedelta(hours=7 * i), "tag") for i in range(60)]
    done = ended(spark.createDataFrame(rows, "id string, finished_at timestamp, last_actor string"))
    base = scratch(spark, "terminals")
    write_terminal(done.coalesce(1), base, batch="1", index=True)
    listed = lambda found: sum(f"{base}/" in f for f in found.inputFiles())
    one = read_terminal(spark, base, id="e7", index=True)
    assert [r.id for r in one.collect()] == ["e7"] and listed(one) == 1
    with patch.object(results, "FOLDERS", 5):  # more folders than are named, on five days
        some = read_terminal(spark, base, prefix="e5", index=True)
        assert some.count() == 11 and 11 <= listed(some) < 20
        many = read_terminal(spark, base, prefix="e", index=True)
        assert many.count() == 60 and listed(many) == 60
    # an index that names a folder which is gone
    write_terminal(done.filter("id <> 'e7'"), base, batch="1")
    assert read_terminal(spark, base, prefix="e", index=True).count() == 59
    assert read_terminal(spark, base, id="e7", index=True).count() == 0


class Handle:
    """A page's value and timer, with the number of calls to the store."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_page_of_envelopes_is_one_value_with_one_timer():
    fold, handle, at = StatusFold(), Handle(), lambda s: T0 + timedelta(seconds=s)
    fold.init(handle)
    clock = lambda s: Mock(getCurrentWatermarkInMs=lambda: ms(s))
    ms = lambda s: int(at(s).timestamp() * 1000)
    fire = lambda s, now: list(fold.handleExpiredTimer(
        (0,), clock(now), Mock(getExpiryTimeInMs=lambda: ms(s))))

    def row(i, seq, status="running", due=None, idx=0):
        return Row(envelope_id=i, seq=seq, status=status, message=None, result=None, error=None,
                   actors=["a", "b"], current_actor_idx=idx, envelope_state="received", ts=at(seq),
                   deadline=None if due is None else at(due))

    rows = [row(f"e{i}", 2 * i + 1, due=100 + i) for i in range(20)]
    rows += [row("e0", 50, "succeeded"), row("e0", 51, "failed"), row("e1", 0, idx=1), row(None, 3)]
    out = {r.id: r for r in fold.handleInputRows((0,), iter(rows), clock(0))}
    assert len(out) == 21 and handle.calls == 3 and handle.timers == {ms(101)}
    assert (out["e0"].status, out["e0"].progress, out["e0"].version) == ("succeeded", 100.0, 1)
    assert (out["e1"].current_actor_name, out["e1"].progress) == ("a", 55.0)
    handle.timers.discard(ms(101))  # Spark removes the one that fired
    late = {r.id: r for r in fire(101, 106)}
    assert sorted(late) == ["e1", "e2", "e3", "e4", "e5"] and handle.timers == {ms(106)}
    assert {r.error for r in late.values()} == {"envelope timed out"}
    assert late["e5"].updated_at == at(105) and late["e5"].version == 2
    out = list(fold.handleInputRows((0,), iter([row("e6", 60, "succeeded"), row("e5", 61)]), clock(106)))
    assert [(r.id, r.status, r.version) for r in out] == [("e6", "succeeded", 2), ("e5", "failed", 3)]
    assert handle.timers == {ms(107)}


def test_arrivals_are_written_by_many_tasks(spark, tmp_path):
    """Each arrival is one micro-batch, of as many files as tasks wrote."""
    spark.range(0, 4000, 1, 8).select(F.col("id").alias("event_id")).write.parquet(
        f"{tmp_path}/events.parquet")
    for arrivals, first in ((streams.arriving, 500), (streams.arriving_in_order, 0)):
        batches, checkpoint = [], scratch(spark, "check")
        for arrived in arrivals(spark, str(tmp_path), "arrivals", lambda e: e):
            arrived.writeStream.foreachBatch(lambda b, i: batches.append(
                (i, b.count(), b.agg(F.min("event_id")).first()[0], b.select(F.input_file_name()).distinct().count()))
            ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(
            ).awaitTermination()
        assert [b[:2] for b in batches] == [(k, 1000) for k in range(4)]
        assert batches[0][2] == first
        assert max(b[3] for b in batches) > 1
