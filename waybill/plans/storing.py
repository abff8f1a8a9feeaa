"""Queries that write a table in the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.payload import enrich
from waybill.functions.route import make_route
from waybill.operators import status as S
from waybill.operators.actors import Registry
from waybill.operators.hops import run, step
from waybill.plans.bindings import docs, json_docs, names, tracked, typed_docs, updates
from waybill.plans.registry import query
from waybill.plans.routing import (
    FAILING_SQL,
    ROUTES_SQL,
    failing_run,
    native_registry,
    python_registry,
)
from waybill.plans.tracking import FOLD_COLUMNS, UPD_SQL, flat_fold
from waybill.session import scratch
from waybill.sources.queues import read_queue, write_routed
from waybill.sources.results import read_terminal, write_terminal
from waybill.sources.state import append_updates, read_snapshot, read_updates, write_snapshot


@query("terminal_roundtrip", f"""WITH {ROUTES_SQL}
SELECT id, parent_id, terminal, last_actor, actors, cursor, words, tag, text_md5 FROM finished""")
def terminal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal rows written as JSON objects and read back."""
    base = scratch(spark, "terminals")
    write_terminal(run(typed_docs(docs(spark, sf_dir)), native_registry(), max_hops=3), base)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return read_terminal(spark, base, terminal="happy-end").select(
        "id", "parent_id", "terminal", "last_actor",
        F.array_join("route.actors", ",").alias("actors"),
        F.col("route.current").alias("cursor"),
        field("words").cast("int").alias("words"), field("tag").alias("tag"),
        F.md5(field("text")).alias("text_md5"),
    )


@query("error_roundtrip", f"""WITH {FAILING_SQL}
SELECT id, failed_actor AS last_actor, error_type, error_message FROM f
WHERE failed AND id LIKE 'doc-1%'""")
def error_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored error envelopes looked up by terminal and id prefix."""
    base = scratch(spark, "errors")
    write_terminal(failing_run(spark, sf_dir), base, compact=True)
    rows = read_terminal(spark, base, prefix="doc-1", terminal="error-end")
    return rows.select(
        "id", "last_actor",
        F.get_json_object("payload", "$.details.type").alias("error_type"),
        F.get_json_object("payload", "$.details.message").alias("error_message"),
    )


@query("state_tables_roundtrip", f"WITH {UPD_SQL} SELECT {', '.join(FOLD_COLUMNS)} FROM fold")
def state_tables_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update log and snapshot written, read back and folded."""
    log, table = scratch(spark, "updates"), scratch(spark, "snapshot")
    upd = updates(spark, sf_dir)
    append_updates(upd, log, compact=True)
    stored = read_updates(spark, log).select(*upd.columns)
    write_snapshot(S.fold_status(tracked(stored), stored), table)
    return flat_fold(read_snapshot(spark, table))


@query("queue_roundtrip", f"""WITH {ROUTES_SQL}
SELECT CASE m WHEN 0 THEN 'chunk' WHEN 1 THEN 'tag' ELSE 'happy-end' END AS queue,
       count(*) AS n, sum(length(text))::BIGINT AS chars, min(1)::INTEGER AS cursor
FROM d GROUP BY ALL""")
def queue_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop written to the queues of its destinations, read per actor."""
    path = scratch(spark, "queues")
    write_routed(step(json_docs(docs(spark, sf_dir)), python_registry(), "prep"), path)
    out = None
    for actor in ("chunk", "tag", "happy-end"):
        rows = read_queue(spark, path, actor).groupBy(F.lit(actor).alias("queue")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length(F.get_json_object("payload", "$.text"))).cast("bigint").alias("chars"),
            F.min("route.current").alias("cursor"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query("long_route", """
SELECT 'doc-' || doc_id AS id, 'happy-end' AS terminal, 15 AS cursor, 15 AS processed_by,
       true AS in_order FROM documents""")
def long_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen steps, the plan cut by a checkpoint every five."""
    steps = [f"hop-{i}" for i in range(15)]
    env = docs(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        make_route(names(*steps)).alias("route"),
        F.struct("lang", F.array().cast("array<string>").alias("processed_by")).alias("payload"),
    )
    reg = Registry()
    for name in steps:
        reg.column_actor(
            name,
            lambda p, n=name: enrich(p, processed_by=F.array_append(p["processed_by"], F.lit(n))),
        )
    done = run(env, reg, max_hops=15, unroll=5)
    return done.select(
        "id", "terminal", F.col("route.current").alias("cursor"),
        F.size("payload.processed_by").alias("processed_by"),
        (F.col("payload.processed_by") == names(*steps)).alias("in_order"),
    )


@query("sink_repeat", f"""WITH {ROUTES_SQL}, {UPD_SQL.strip()}
SELECT 'terminal' AS sink, terminal AS kind, count(*) AS n FROM finished GROUP BY ALL
UNION ALL SELECT 'update', status, count(*) FROM upd GROUP BY ALL""")
def sink_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, each written twice, read once: the repeat replaces the first attempt."""
    base, log = scratch(spark, "terminals"), scratch(spark, "updates")
    env, upd = typed_docs(docs(spark, sf_dir)), updates(spark, sf_dir)
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    for attempt in range(2):
        for k in range(2):
            done = run(env.filter(half == k), native_registry(), max_hops=3)
            # another hour, as after a crash
            at = F.timestamp_seconds(F.lit(1_700_000_000 + 7200 * attempt))
            write_terminal(done.withColumn("finished_at", at), base, batch=str(k))
            append_updates(upd.filter(F.col("seq") % 2 == k), log, batch=str(k))
    one = read_terminal(spark, base).groupBy(F.col("terminal").alias("kind"))
    two = read_updates(spark, log).groupBy(F.col("status").alias("kind"))
    count = lambda rows, sink: rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(sink).alias("sink"), "kind", "n")
    return count(one, "terminal").unionByName(count(two, "update"))


@query("terminal_lookup", f"""WITH {ROUTES_SQL}
SELECT id, last_actor, cursor, text_md5 FROM finished
WHERE id = 'doc-7' OR id LIKE 'doc-11%'""")
def terminal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminals of one id, and of the ids with a prefix, by way of the index."""
    base = scratch(spark, "terminals")
    done = run(typed_docs(docs(spark, sf_dir)), native_registry(), max_hops=3)
    # ends in many hours
    number = F.regexp_extract("id", r"(\d+)", 1).cast("bigint")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + number * 600)
    write_terminal(done.withColumn("finished_at", at), base, batch="all", index=True)
    one = read_terminal(spark, base, id="doc-7", index=True)
    more = read_terminal(spark, base, prefix="doc-11", terminal="happy-end", index=True)
    return one.unionByName(more).select(
        "id", "last_actor", F.col("route.current").alias("cursor"),
        F.md5(F.get_json_object("payload", "$.text")).alias("text_md5"),
    )
