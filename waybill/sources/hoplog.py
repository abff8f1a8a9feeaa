"""The hop log of per-actor streams as a table that only shows whole batches.

``rows/`` has each batch's routed rows with their log entries, written once and then sent on
to the queues; ``batches/`` gets one row per batch when all of it is done: when the batch was
received, handled and sent. A batch without that row never ended and is not read; one that is
repeated replaces its own files in both.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.schema import TRACE_ENTRY

BATCH = ("actor string, batch bigint, received_at timestamp, handled_at timestamp, "
         "sent_at timestamp, n bigint")


def store_rows(rows: DataFrame, path: str, actor: str, batch: int) -> DataFrame:
    """Write a batch's rows and read them back: handlers run once, whatever reads them."""
    place = f"{path}/rows/actor={actor}/batch={batch}"
    rows.write.mode("overwrite").parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def commit_batch(
    spark: SparkSession, path: str, actor: str, batch: int, n: int, *times: datetime
) -> None:
    """Make a batch visible: when it was received, handled and sent."""
    row = spark.createDataFrame([(actor, batch, *times, n)], BATCH).coalesce(1)
    row.write.mode("overwrite").parquet(f"{path}/batches/actor={actor}/batch={batch}")


def read_log(spark: SparkSession, path: str, transport: str = "table") -> DataFrame:
    """Hop log in the columns the reports read, of all batches that ended.

    ``received_at`` to ``sent_at`` is a row's time in work (``processing_s``). ``receive_s``
    is the time from its queue to its batch, ``duration_s`` that of the handler's own call and
    ``send_s`` that of writing the batch to its next queues. Times stand with the first output
    of a hop (``pos = 0``).
    """
    entries = f"actor string, batch bigint, trace array<{TRACE_ENTRY.simpleString()}>"
    rows = spark.read.schema(entries).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    named = spark.read.schema(BATCH).option("basePath", f"{path}/batches").parquet(
        f"{path}/batches"
    ).select(F.col("actor").alias("__actor"), F.col("batch").alias("__batch"),
             "received_at", "handled_at", "sent_at")
    log = rows.select("actor", "batch", F.explode("trace").alias("t")).join(
        named, (F.col("actor") == F.col("__actor")) & (F.col("batch") == F.col("__batch"))
    )
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / F.lit(1e6)
    first = F.col("t.pos") == 0
    once = lambda c, name: F.when(first, c).alias(name)
    timed = ("enqueued_at", "duration_s")
    cells = [F.col(f"t.{f.name}").alias(f.name) for f in TRACE_ENTRY.fields
             if f.name not in ("actor", "started_at", *timed)]
    return log.select(
        F.col("t.actor").alias("queue"), F.lit(transport).alias("transport"), *cells,
        *[once(F.col(f"t.{c}"), c) for c in timed],
        once(F.greatest("received_at", "t.started_at"), "called_at"),
        once(F.col("received_at"), "started_at"), once(F.col("sent_at"), "ended_at"),
        once(F.greatest(F.lit(0.0), seconds("t.enqueued_at", "received_at")), "receive_s"),
        once(seconds("received_at", "sent_at"), "processing_s"),
        once(seconds("handled_at", "sent_at"), "send_s"),
    )
