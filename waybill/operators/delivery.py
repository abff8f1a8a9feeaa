"""Delivery attempts, redelivery, dead letters and duplicate deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators.scan import ordinal, seq_chunk

MAX_ATTEMPTS = 3


def attempts(
    deliveries: DataFrame, key: str = "id", order: str = "seq", chunk: Column | None = None
) -> DataFrame:
    """Attempt number of every delivery."""
    return ordinal(deliveries, [key], [order], seq_chunk(order) if chunk is None else chunk,
                   "attempt")


def redeliverable(tries: DataFrame, key: str = "id", outcome: str = "outcome") -> DataFrame:
    """Keys whose last attempt was nacked: they are offered again.

    One aggregation keeps the last outcome and attempt number per key.
    """
    last = tries.groupBy(key).agg(
        F.max_by(outcome, "attempt").alias("last_outcome"), F.max("attempt").alias("attempts")
    )
    return last.filter(F.col("last_outcome") == "nack").drop("last_outcome")


def redrive(tries: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Deliveries with where they go: ``dead-letter`` past the limit, else ``queue``."""
    over = F.col("attempt") > max_attempts
    return tries.withColumn("target", F.when(over, "dead-letter").otherwise("queue"))


def dedup(df: DataFrame, keys: tuple[str, ...] = ("id", "hop"), watermark: str | None = None,
          ts: str = "ts") -> DataFrame:
    """One row per (id, hop). A stream needs a watermark to bound its state."""
    if df.isStreaming:
        if watermark is None:
            raise ValueError("a stream needs a watermark")
        return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))
