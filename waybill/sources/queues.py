"""Actor queues as directories of routed envelopes.

A queue is the ``dest=<actor>`` partition of a table. Reading it as a stream
gives at-least-once delivery: the checkpoint is the acknowledgement. Where a
broker connector is on the class path the same rows can be read from a topic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.schema import ENVELOPE


def _schema(payload: str = "string") -> T.StructType:
    kind = T.StructType.fromDDL(f"p {payload}").fields[0].dataType
    return T.StructType(
        [T.StructField("payload", kind) if f.name == "payload" else f for f in ENVELOPE.fields]
        + [T.StructField("hop", T.IntegerType()), T.StructField("enqueued_at", T.TimestampType())]
    )


def write_routed(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append each envelope to the queue of its destination (column ``dest``).

    With ``batch`` the rows land in a partition of that name which is replaced
    when the same batch is written again. ``enqueued_at`` is the time of writing unless given.
    """
    columns = [f.name for f in ENVELOPE.fields]
    hop = F.col("hop") if "hop" in df.columns else F.lit(0)
    at = F.col("enqueued_at") if "enqueued_at" in df.columns else F.current_timestamp()
    rows = df.select(*columns, hop.cast("int").alias("hop"), at.alias("enqueued_at"), "dest")
    if batch is None:
        rows.write.mode("append").partitionBy("dest").parquet(path)
        return
    (
        rows.withColumn("batch", F.lit(batch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dest", "batch")
        .parquet(path)
    )


def queue_path(path: str, actor: str) -> str:
    return f"{path}/dest={actor}"


def read_queue(
    spark: SparkSession,
    path: str,
    actor: str,
    *,
    stream: bool = False,
    payload: str = "string",
    max_files: int | None = None,
) -> DataFrame:
    """Envelopes waiting for one actor, as a table or as a stream."""
    reader = spark.readStream if stream else spark.read
    reader = reader.schema(_schema(payload)).option("recursiveFileLookup", "true")
    if stream and max_files is not None:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.parquet(queue_path(path, actor))
