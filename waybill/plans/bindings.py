"""How the given tables read as envelopes, updates, hops and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.functions.route import make_route
from waybill.operators.status import with_deadline

WORDS = r"[^ \t\n\r]+"
STORED_ROUTE = ("ingest", "score", "store")
LONGER_ROUTE = ("ingest", "score", "review", "sign", "store")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(ts: Column | str) -> Column:
    """Timestamp as a plain UTC wall-clock value for output."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts.cast("timestamp_ntz")


def names(*actors: str) -> Column:
    return F.array(*[F.lit(a) for a in actors]).cast("array<string>")


def doc_route(doc_id: Column) -> Column:
    return (
        F.when(doc_id % 3 == 0, names("prep", "chunk", "tag"))
        .when(doc_id % 3 == 1, names("prep", "tag"))
        .otherwise(names("prep"))
    )


def typed_docs(docs: DataFrame, actors: Column | None = None) -> DataFrame:
    """Documents as envelopes with a typed payload."""
    actors = doc_route(F.col("doc_id")) if actors is None else actors
    payload = F.struct(
        F.col("text"),
        F.col("lang"),
        F.lit(None).cast("int").alias("words"),
        F.lit(None).cast("string").alias("tag"),
    )
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        make_route(actors).alias("route"),
        payload.alias("payload"),
    )


def json_docs(docs: DataFrame, actors: Column | None = None) -> DataFrame:
    """Documents as envelopes with a JSON payload."""
    actors = doc_route(F.col("doc_id")) if actors is None else actors
    return docs.select(
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("id"),
        F.lit(None).cast("string").alias("parent_id"),
        make_route(actors).alias("route"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
        .alias("headers"),
        F.to_json(F.struct("text", "lang", "n_chars")).alias("payload"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def update_columns(events: DataFrame) -> DataFrame:
    """Events as update-log rows."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    ts = F.col("ts").cast("timestamp")
    return events.select(
        F.concat(F.col("user_id"), F.lit("-"), F.to_date(ts).cast("string")).alias("envelope_id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "signup", "succeeded")
        .when(kind == "error", "failed")
        .otherwise("running")
        .alias("status"),
        F.concat(F.lit("saw "), kind).alias("message"),
        F.when(kind == "signup", F.concat(F.lit("r"), k)).alias("result"),
        F.when(kind == "error", F.concat(F.lit("e"), k)).alias("error"),
        F.when(k >= 90, names(*LONGER_ROUTE))
        .when(k >= 30, names(*STORED_ROUTE))
        .otherwise(names())
        .alias("actors"),
        F.when(kind != "signup", k % 3).cast("int").alias("current_actor_idx"),
        F.when(kind == "view", "received")
        .when(kind == "click", "processing")
        .when(kind == "purchase", "completed")
        .alias("envelope_state"),
        ts.alias("ts"),
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_columns(table(spark, sf_dir, "events"))


def tracked(upd: DataFrame) -> DataFrame:
    """One stored envelope per id of the log, created at its first row, open for a day."""
    first = upd.groupBy(F.col("envelope_id").alias("id")).agg(F.min("ts").alias("created_at"))
    return with_deadline(
        first.withColumn("actors", names(*STORED_ROUTE)).withColumn("timeout_sec", F.lit(86400))
    )


def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a hop log."""
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    ts = F.col("ts").cast("timestamp")
    shift = lambda seconds: F.timestamp_micros(
        F.unix_micros(ts) + F.round(seconds * 1e6).cast("bigint")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        kind.alias("queue"),
        F.lit("files").alias("transport"),
        (k % 10 == 0).cast("int").alias("pos"),
        F.when(kind == "error", "runtime_error")
        .when(kind == "signup", "end_consumed")
        .when((kind == "purchase") & (k % 2 == 0), "empty_response")
        .otherwise("success")
        .alias("outcome"),
        F.when((kind == "error") & (k < 50), "execution_error")
        .when(kind == "error", "ValueError")
        .alias("error_type"),
        F.when(kind.isin("view", "click"), "routing")
        .when(kind == "purchase", "happy_end")
        .when(kind == "error", "error_end")
        .alias("message_type"),
        F.when(kind == "view", "click")
        .when(kind == "click", "purchase")
        .when(kind == "purchase", "happy-end")
        .when(kind == "error", "error-end")
        .alias("dest"),
        F.octet_length("props").cast("bigint").alias("size"),
        "value",
        (F.col("value") / F.lit(100.0)).alias("duration_s"),
        shift(-k * F.lit(60.0)).alias("enqueued_at"),
        ts.alias("started_at"),
        shift(F.col("value") * F.lit(60.0)).alias("ended_at"),
    )


# the same readings for the SQL twins
UPD_SQL = """
upd AS (
  SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS envelope_id, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'succeeded' WHEN 'error' THEN 'failed'
              ELSE 'running' END AS status,
         'saw ' || event_type AS message,
         CASE WHEN event_type = 'signup' THEN 'r' || k END AS result,
         CASE WHEN event_type = 'error' THEN 'e' || k END AS error,
         CASE WHEN k >= 90 THEN 5 WHEN k >= 30 THEN 3 ELSE 0 END AS n_actors,
         CASE WHEN event_type <> 'signup' THEN k % 3 END AS idx,
         CASE event_type WHEN 'view' THEN 'received' WHEN 'click' THEN 'processing'
              WHEN 'purchase' THEN 'completed' END AS state,
         ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
), env AS (
  SELECT envelope_id, min(ts) AS created_at, min(ts) + INTERVAL 1 DAY AS deadline
  FROM upd GROUP BY ALL
), ends AS (
  SELECT envelope_id, min(seq) FILTER (status IN ('succeeded', 'failed')) AS final_seq
  FROM upd GROUP BY ALL
), ordered AS (
  SELECT upd.*, coalesce(seq > final_seq, false) AS late,
         greatest(3, max(n_actors) OVER (PARTITION BY envelope_id ORDER BY seq)) AS n
  FROM upd JOIN ends USING (envelope_id)
), scored AS (
  SELECT *, CASE WHEN status IN ('succeeded', 'failed') THEN 100.0::DOUBLE
    ELSE least(100.0::DOUBLE, (idx * 100 + CASE state WHEN 'received' THEN 10
      WHEN 'processing' THEN 50 WHEN 'completed' THEN 100 ELSE 0 END)::DOUBLE / n) END AS raw
  FROM ordered
), fold AS (
  SELECT envelope_id AS id,
         arg_max(status, seq) AS status,
         arg_max(result, seq) FILTER (result IS NOT NULL) AS result,
         arg_max(error, seq) FILTER (error IS NOT NULL) AS error,
         arg_max(message, seq) AS message,
         CASE arg_max(n, seq) WHEN 5 THEN 'ingest,score,review,sign,store'
              ELSE 'ingest,score,store' END AS actors,
         arg_max(n, seq)::INTEGER AS total_actors,
         round(max(raw), 2) AS progress_percent,
         arg_max(idx, seq) FILTER (idx IS NOT NULL)::INTEGER AS current_actor_idx,
         arg_max((CASE n WHEN 5 THEN ['ingest', 'score', 'review', 'sign', 'store']
              ELSE ['ingest', 'score', 'store'] END)[idx + 1], seq)
           FILTER (idx IS NOT NULL) AS current_actor_name,
         count(DISTINCT idx) FILTER (state = 'completed')::INTEGER AS actors_completed,
         max(ts) AS updated_at
  FROM scored WHERE NOT late GROUP BY ALL
)
"""

HOP_SQL = """
hop AS (
  SELECT event_id, event_type AS queue, 'files' AS transport, (k % 10 = 0)::INTEGER AS pos,
         CASE WHEN event_type = 'error' THEN 'runtime_error'
              WHEN event_type = 'signup' THEN 'end_consumed'
              WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'empty_response'
              ELSE 'success' END AS outcome,
         CASE WHEN event_type = 'error' AND k < 50 THEN 'execution_error'
              WHEN event_type = 'error' THEN 'ValueError' END AS error_type,
         CASE WHEN event_type IN ('view', 'click') THEN 'routing'
              WHEN event_type = 'purchase' THEN 'happy_end'
              WHEN event_type = 'error' THEN 'error_end' END AS message_type,
         CASE event_type WHEN 'view' THEN 'click' WHEN 'click' THEN 'purchase'
              WHEN 'purchase' THEN 'happy-end' WHEN 'error' THEN 'error-end' END AS dest,
         strlen(props) AS size, value, value / 100.0::DOUBLE AS duration_s,
         ts - to_seconds(k * 60) AS enqueued_at, ts AS started_at,
         ts + to_microseconds(CAST(round(value * 60.0::DOUBLE * 1e6) AS BIGINT)) AS ended_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)
"""
