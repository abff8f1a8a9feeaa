"""Streaming runs: whole routes per micro-batch, or one query per actor."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waybill.operators.actors import Registry
from waybill.operators.hops import run, step
from waybill.operators.terminal import error_payload
from waybill.schema import ERROR_END
from waybill.sources.hoplog import commit_batch, store_rows
from waybill.sources.queues import read_queue, write_routed


def _start(stream: DataFrame, each, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_stream(
    stream: DataFrame,
    registry: Registry,
    out: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Each micro-batch runs every hop to a terminal.

    A batch is written once, with its traces, into its own ``batch_id``
    partition; writing it again after a failure replaces it. Terminals and hop
    log are both read from that table.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        done = run(batch, registry, **options)
        (
            done.withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(out)
        )

    return _start(stream, each, checkpoint, available_now)


def run_actor_stream(
    spark: SparkSession,
    queues: str,
    actor: str,
    registry: Registry,
    checkpoint: str,
    *,
    available_now: bool = True,
    max_files: int | None = None,
    log: str | None = None,
    **options,
) -> StreamingQuery:
    """One actor's own query: read its queue, do one hop, write to the next queues.

    Each actor scales and restarts by itself. Rows whose route points elsewhere
    go to the error queue. The number of a hop is that of the row's own way so far.
    With ``log`` the routed rows are written there first and sent on from there, and
    ``hoplog.read_log`` gives their hops with the times of batch and call. ``options`` are
    those of a hop (``on_collision``, ``max_visits``).
    """
    stream = read_queue(spark, queues, actor, stream=True, max_files=max_files)
    now = lambda: datetime.now(timezone.utc)

    def each(batch: DataFrame, batch_id: int) -> None:
        received = now()
        # sent on with the time of sending, not that of its own arrival
        routed = step(batch, registry, actor, "hop + 1", **options).drop("since")
        wrapped = error_payload(
            F.col("failure.error"), F.col("failure.details"), F.col("payload")
        )
        rows = routed.withColumn(
            "payload", F.when(F.col("dest") == ERROR_END, wrapped).otherwise(F.col("payload"))
        ).withColumn("hop", F.col("hop") + 1)
        if log is not None:
            rows = store_rows(rows, log, actor, batch_id)
        handled = now()
        write_routed(rows, queues, batch=f"{actor}-{batch_id}")
        if log is not None:
            commit_batch(spark, log, actor, batch_id, rows.count(), received, handled, now())

    return _start(stream, each, checkpoint, available_now)
