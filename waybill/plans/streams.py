"""Streaming twins: the same tables read as streams, drained with ``availableNow``.

Each gives the rows of its batch twin. Results are written to the shared folder
and read back once the stream has drained.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.functions.text import is_final
from waybill.operators import delivery as D
from waybill.operators.hops import hop_log
from waybill.plans import bindings as B
from waybill.plans.bindings import HOP_SQL, UPD_SQL, utc
from waybill.plans.registry import query
from waybill.plans.routing import ROUTES_SQL, flat_typed, native_registry, python_registry
from waybill.session import scratch
from waybill.sources.hoplog import read_log
from waybill.sources.queues import read_queue, write_routed
from waybill.streaming.hops import run_actor_stream, run_stream
from waybill.streaming.status import (
    attempts_stream,
    fold_status_stream,
    latest,
    rate_stream,
    read_status,
    run_attempts_stream,
    run_dedup_stream,
    run_status_stream,
    tail,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = B.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def drain(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table of the shared folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = scratch(spark, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(path)
        )

    (
        df.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", scratch(spark, f"{name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(df.schema.add("batch_id", T.IntegerType())).parquet(path)


@query("stream_run", f"WITH {ROUTES_SQL} SELECT * FROM finished")
def stream_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole routes per micro-batch."""
    out, checkpoint = scratch(spark, "run"), scratch(spark, "run-checkpoint")
    env = B.typed_docs(stream_table(spark, sf_dir, "documents"))
    run_stream(env, native_registry(), out, checkpoint, max_hops=3).awaitTermination()
    return flat_typed(spark.read.parquet(out))


@query("stream_hop_log", f"""WITH {ROUTES_SQL}, s AS (
  SELECT 'prep' AS actor FROM d UNION ALL
  SELECT 'chunk' FROM lines UNION ALL SELECT 'tag' FROM lines UNION ALL
  SELECT 'tag' FROM d WHERE m = 1)
SELECT actor, count(*) AS n FROM s GROUP BY ALL""")
def stream_hop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hop log of a streaming run, read from the same table as its terminals."""
    out, checkpoint = scratch(spark, "run"), scratch(spark, "run-checkpoint")
    env = B.typed_docs(stream_table(spark, sf_dir, "documents"))
    run_stream(env, native_registry(), out, checkpoint, max_hops=3).awaitTermination()
    return hop_log(spark.read.parquet(out)).groupBy("actor").agg(F.count(F.lit(1)).alias("n"))


@query("stream_actors", f"""WITH {ROUTES_SQL}
SELECT id, parent_id, actors, cursor, words, tag, text_md5 FROM finished""")
def stream_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per actor, chained by queue tables."""
    queues = scratch(spark, "queues")
    env = B.json_docs(B.docs(spark, sf_dir))
    write_routed(env.withColumn("dest", F.lit("prep")), queues, batch="submitted")
    registry = python_registry()
    for actor in ("prep", "chunk", "tag"):
        checkpoint = scratch(spark, f"{actor}-checkpoint")
        run_actor_stream(spark, queues, actor, registry, checkpoint).awaitTermination()
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return read_queue(spark, queues, "happy-end").select(
        "id", "parent_id",
        F.array_join("route.actors", ",").alias("actors"),
        F.col("route.current").alias("cursor"),
        field("words").cast("int").alias("words"), field("tag").alias("tag"),
        F.md5(field("text")).alias("text_md5"),
    )


@query("stream_actors_hop_log", f"""WITH {ROUTES_SQL}, s AS (
  SELECT 'prep' AS queue, 1 AS hop, 1 AS received, CASE m WHEN 2 THEN 'happy_end' ELSE 'routing' END
    AS message_type FROM d
  UNION ALL SELECT 'chunk', 2, (pos = 0)::INTEGER, 'routing' FROM lines
  UNION ALL SELECT 'tag', 3, 1, 'happy_end' FROM lines
  UNION ALL SELECT 'tag', 2, 1, 'happy_end' FROM d WHERE m = 1)
SELECT queue, hop, 'success' AS outcome, message_type, sum(received)::BIGINT AS received,
       count(*) AS sent, true AS in_order, sum(received)::BIGINT AS timed FROM s GROUP BY ALL""")
def stream_actors_hop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hop log of actor streams: hop numbers, and the times of queue, batch and call."""
    queues, log = scratch(spark, "queues"), scratch(spark, "hop-log")
    env = B.json_docs(B.docs(spark, sf_dir))
    write_routed(env.withColumn("dest", F.lit("prep")), queues, batch="submitted")
    for actor in ("prep", "chunk", "tag"):
        checkpoint = scratch(spark, f"{actor}-checkpoint")
        run_actor_stream(spark, queues, actor, python_registry(), checkpoint, log=log
                         ).awaitTermination()
    rows = read_log(spark, log)
    order = ("enqueued_at", "started_at", "called_at", "ended_at")
    late = [F.col(a) > F.col(b) for a, b in zip(order, order[1:])]
    timed = [F.col(c) >= 0 for c in ("duration_s", "receive_s", "processing_s", "send_s")]
    return rows.groupBy("queue", "hop", "outcome", "message_type").agg(
        F.count_if(F.col("pos") == 0).alias("received"),
        F.count(F.lit(1)).alias("sent"),
        (F.count_if(late[0] | late[1] | late[2]) == 0).alias("in_order"),
        F.count_if(timed[0] & timed[1] & timed[2] & timed[3]).alias("timed"),
    )


def creation_and_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation rows and updates as one stream; each update names the stored route."""
    upd = B.update_columns(stream_table(spark, sf_dir, "events"))
    actors = F.when(F.size("actors") > 0, F.col("actors")).otherwise(B.names(*B.STORED_ROUTE))
    return upd.withColumn("actors", actors).withColumn(
        "deadline", F.to_timestamp(F.date_add(F.to_date("ts"), 2))
    )


@query("stream_status", f"""WITH {UPD_SQL}, closing AS (
  SELECT fold.*, status = 'running' AND
         CAST(substr(id, strpos(id, '-') + 1) AS DATE) + INTERVAL 2 DAY
           < (SELECT max(ts) - INTERVAL 10 MINUTE FROM upd) AS expired FROM fold)
SELECT id, CASE WHEN expired THEN 'failed' ELSE status END AS status, result,
       CASE WHEN expired THEN 'envelope timed out' ELSE error END AS error, message, actors,
       CASE WHEN expired THEN 100.0::DOUBLE ELSE progress_percent END AS progress,
       current_actor_idx, current_actor_name FROM closing""")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful fold: the newest version per envelope equals the batch fold.

    Open envelopes are failed by their deadline timer once the watermark passes it.
    """
    changes = drain(
        fold_status_stream(creation_and_updates(spark, sf_dir)), spark, "status", "update"
    )
    return latest(changes.drop("batch_id")).select(
        "id", "status", "result", "error", "message",
        F.array_join("actors", ",").alias("actors"),
        F.round("progress", 2).alias("progress"),
        "current_actor_idx", "current_actor_name",
    )


@query("stream_status_table", f"""WITH {UPD_SQL}, closing AS (
  SELECT fold.*, status = 'running' AND deadline < (SELECT max(ts) FROM upd) AS expired
  FROM fold JOIN env ON env.envelope_id = fold.id)
SELECT id, CASE WHEN expired THEN 'failed' ELSE status END AS status, result,
       CASE WHEN expired THEN 'envelope timed out' ELSE error END AS error, message, actors,
       CASE WHEN expired THEN 100.0::DOUBLE ELSE progress_percent END AS progress,
       current_actor_idx, current_actor_name, actors_completed FROM closing""")
def stream_status_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches folded into a state table, deadlines included."""
    path, checkpoint = scratch(spark, "status-table"), scratch(spark, "status-table-checkpoint")
    run_status_stream(
        B.update_columns(stream_table(spark, sf_dir, "events")), path, checkpoint,
        stored=B.tracked(B.updates(spark, sf_dir)),
    ).awaitTermination()
    return read_status(spark, path).select(
        "id", "status", "result", "error", "message",
        F.array_join("actors", ",").alias("actors"),
        F.col("progress_percent").alias("progress"),
        "current_actor_idx", "current_actor_name", "actors_completed",
    )


# events dealt to four files, which arrive in this order
ARRIVAL = (2, 0, 3, 1)


def arriving(spark: SparkSession, sf_dir: str, name: str, columns, order=ARRIVAL
             ) -> Iterator[DataFrame]:
    """Events as a stream of several arrivals, each a micro-batch of its own.

    An arrival is written when the stream is asked for again, by as many tasks as read it: a
    stream that is run until it has drained takes all its files at once.
    """
    rows = B.table(spark, sf_dir, "events")
    part = F.floor(F.col("event_id") % 1000 / 250)
    return _arrivals(spark, scratch(spark, name), (columns(rows.filter(part == k)) for k in order))


def _arrivals(spark: SparkSession, path: str, parts: Iterable[DataFrame]) -> Iterator[DataFrame]:
    for part in parts:
        part.write.mode("append").parquet(path)
        yield spark.readStream.schema(part.schema).parquet(path)


ARRIVAL_SQL = "CASE event_id % 1000 // 250 WHEN 2 THEN 0 WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 3 END"


@query("stream_status_hot", f"""WITH {UPD_SQL.replace(
    "SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS envelope_id",
    "SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'hot' "
    "ELSE user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS envelope_id")}
SELECT id, status, result, error, message, actors, progress_percent AS progress,
       current_actor_idx, current_actor_name, actors_completed,
       (SELECT count(*) FROM ordered WHERE NOT late AND envelope_id = fold.id) AS n_updates
FROM fold""")
def stream_status_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope with most updates, created again in every file, over many micro-batches."""
    def rows(events: DataFrame) -> DataFrame:
        upd = B.update_columns(events)
        hot = F.col("status") == "running"
        upd = upd.withColumn(
            "envelope_id", F.when(hot, F.lit("hot")).otherwise(F.col("envelope_id")))
        made = upd.groupBy("envelope_id").agg(F.min("ts").alias("ts")).withColumns(
            {"seq": F.lit(-1).cast("bigint"), "actors": B.names(*B.STORED_ROUTE)})
        return upd.unionByName(made, allowMissingColumns=True)

    path, checkpoint = scratch(spark, "status-hot"), scratch(spark, "status-hot-checkpoint")
    for arrived in arriving_in_order(spark, sf_dir, "updates-hot", rows):
        run_status_stream(arrived, path, checkpoint, compact=2).awaitTermination()
    return read_status(spark, path).select(
        "id", "status", "result", "error", "message",
        F.array_join("actors", ",").alias("actors"), F.col("progress_percent").alias("progress"),
        "current_actor_idx", "current_actor_name", "actors_completed", "n_updates",
    )


def arriving_in_order(spark: SparkSession, sf_dir: str, name: str, columns) -> Iterator[DataFrame]:
    """Events as four arrivals in the order of their ids."""
    rows = B.table(spark, sf_dir, "events")
    top = rows.agg(F.max("event_id")).first()[0] + 1
    part = (F.col("event_id") * 4 / top).cast("int")
    return _arrivals(spark, scratch(spark, name), (columns(rows.filter(part == k)) for k in range(4)))


@query("stream_attempts", """
SELECT 'u' || user_id AS id, event_id AS seq,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt,
       CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 3
            THEN 'dead-letter' ELSE 'queue' END AS target
FROM events WHERE event_type = 'error'""")
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery attempts counted in state."""
    rows = stream_table(spark, sf_dir, "events").filter("event_type = 'error'").select(
        F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.col("event_id").alias("seq")
    )
    out = drain(attempts_stream(rows), spark, "attempts")
    return D.redrive(out).select("id", "seq", "attempt", "target")


@query("stream_attempts_hot", f"""WITH n AS (
  SELECT CASE WHEN event_type = 'error' THEN 'u' || user_id ELSE 'hot' END AS id, event_id AS seq,
         {ARRIVAL_SQL} AS arrival FROM events)
SELECT id, seq, row_number() OVER (PARTITION BY id ORDER BY arrival, seq) AS attempt,
       CASE WHEN row_number() OVER (PARTITION BY id ORDER BY arrival, seq) > 3
            THEN 'dead-letter' ELSE 'queue' END AS target FROM n""")
def stream_attempts_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of one key with most deliveries, whose files arrive out of order."""
    key = F.when(F.col("event_type") == "error", F.concat(F.lit("u"), F.col("user_id")))
    path, checkpoint = scratch(spark, "attempts-hot"), scratch(spark, "attempts-hot-checkpoint")
    for rows in arriving(spark, sf_dir, "deliveries", lambda e: e.select(
            key.otherwise(F.lit("hot")).alias("id"), F.col("event_id").alias("seq"))):
        run_attempts_stream(rows, path, checkpoint, compact=2).awaitTermination()
    out = spark.read.parquet(f"{path}/rows")
    return D.redrive(out).select("id", "seq", "attempt", "target")


@query("stream_dedup", "SELECT DISTINCT 'u' || user_id AS id, event_type AS hop FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate deliveries dropped, however far apart they arrive."""
    path, checkpoint = scratch(spark, "dedup"), scratch(spark, "dedup-checkpoint")
    for rows in arriving(spark, sf_dir, "duplicates", lambda e: e.select(
            F.concat(F.lit("u"), F.col("user_id")).alias("id"), F.col("event_type").alias("hop"),
            F.col("ts").cast("timestamp").alias("ts"))):
        run_dedup_stream(rows, path, checkpoint).awaitTermination()
    return spark.read.parquet(path).select("id", "hop")


@query("stream_rate", f"""WITH {HOP_SQL}, w AS (
  SELECT queue, epoch(time_bucket(INTERVAL 1 MINUTE, started_at))::BIGINT AS step FROM hop)
SELECT queue, to_timestamp(step - o * 60)::TIMESTAMP AS window_start, count(*) AS n,
       round(count(*) / 300.0::DOUBLE, 6) AS per_second
FROM w, (SELECT unnest([0, 1, 2, 3, 4]) AS o) GROUP BY queue, step - o * 60""")
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding rates kept as streaming state."""
    rows = stream_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("queue"), F.col("ts").cast("timestamp").alias("started_at")
    )
    changes = drain(rate_stream(rows, "started_at", ["queue"]), spark, "rate", "update")
    final = changes.groupBy("queue", "window_start").agg(
        F.max_by(F.struct("n", "per_second"), "batch_id").alias("s")
    )
    return final.select(
        "queue", utc("window_start").alias("window_start"), "s.n",
        F.round("s.per_second", 6).alias("per_second"),
    )


@query("stream_tail", f"""WITH {UPD_SQL}, chosen AS (
  SELECT min(envelope_id) AS envelope_id FROM upd WHERE status IN ('succeeded', 'failed'))
SELECT envelope_id, seq, message FROM upd JOIN chosen USING (envelope_id)""")
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full history of one envelope, then its new updates, until it is final."""
    ended = B.updates(spark, sf_dir).filter(is_final(F.col("status")))
    # a tail is asked for by id; one aggregated value picks it here
    chosen = ended.agg(F.min("envelope_id")).first()[0]
    path = scratch(spark, "tail")
    stream = B.update_columns(stream_table(spark, sf_dir, "events"))
    ended = tail(stream, [chosen], lambda b: b.write.mode("append").parquet(path),
                 scratch(spark, "tail-checkpoint")).wait()
    if not ended:
        raise RuntimeError(f"the tail of {chosen} stopped before its final status")
    return spark.read.parquet(path).select("envelope_id", "seq", "message")
