"""The update log and the state snapshot as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_updates(
    upd: DataFrame, path: str, *, batch: str | None = None, compact: bool = False
) -> None:
    """Append updates, partitioned by day.

    With ``batch`` they go to a folder of that name; the same batch written again replaces it
    as a whole, whatever days its first attempt wrote. A log takes either named batches or
    none. ``compact`` trades one shuffle for fewer and evenly sized files per day.
    """
    dated = upd.withColumn("date", F.to_date("ts"))
    if compact:
        dated = dated.hint("rebalance", "date")
    if batch is None:
        dated.write.mode("append").partitionBy("date").parquet(path)
        return
    dated.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
        "date").parquet(f"{path}/batch={batch}")


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stream_updates(
    spark: SparkSession, path: str, schema: StructType, max_files: int = 64
) -> DataFrame:
    """The log as a stream. ``max_files`` bounds a micro-batch, and with it the
    rows of one envelope that meet in a stateful task."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files)).parquet(path)
    )


def write_snapshot(snap: DataFrame, path: str, by: str | None = None) -> None:
    """Write current state; with ``by`` only the partitions present are replaced."""
    writer = snap.write.mode("overwrite")
    if by is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    writer.parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
