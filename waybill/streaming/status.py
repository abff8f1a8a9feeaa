"""Stateful tracking: status fold with deadline timers, attempts, live tail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from waybill.functions.text import is_final
from waybill.operators.delivery import attempts
from waybill.operators.status import CREATED_SEQ, expire, fold_status, is_due
from waybill.sources.slots import COMPACT, StateTable
from waybill.streaming.processors import SNAPSHOT, AttemptCount, StatusFold


PAGES = 65536


def fold_status_stream(
    updates: DataFrame, watermark: str = "10 minutes", pages: int = PAGES
) -> DataFrame:
    """Snapshot rows as they change, one per envelope and micro-batch.

    ``updates`` carries the update log and creation rows (``seq = -1`` with the
    stored route, and ``deadline``). The newest ``version`` of an id is its
    state. Envelopes are dealt to ``pages`` by their ids; the state of a page is read and
    written as one value, so a page should hold some tens or hundreds of envelopes. The number
    of pages is fixed by a checkpoint. The source's admission limit (``maxFilesPerTrigger``)
    bounds how many rows of one page meet in a task.
    """
    page = F.pmod(F.xxhash64("envelope_id"), F.lit(pages)).alias("page")
    keyed = updates.withWatermark("ts", watermark).select("*", page).groupBy("page")
    return keyed.transformWithState(
        statefulProcessor=StatusFold(),
        outputStructType=SNAPSHOT,
        outputMode="Update",
        timeMode="EventTime",
    )


def latest(changes: DataFrame) -> DataFrame:
    """Current state from the changes written so far."""
    row = F.struct(*[c for c in changes.columns if c != "id"])
    return changes.groupBy("id").agg(F.max_by(row, "version").alias("s")).select("id", "s.*")


_TEXTS = T.ArrayType(T.StringType())
STATUS = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("id", "parent_id", "payload")],
    T.StructField("timeout_sec", T.IntegerType()),
    T.StructField("deadline", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
    *[T.StructField(c, T.StringType()) for c in ("status", "result", "error", "message")],
    T.StructField("actors", _TEXTS),
    T.StructField("progress_percent", T.DoubleType()),
    T.StructField("current_actor_idx", T.IntegerType()),
    T.StructField("current_actor_name", T.StringType()),
    T.StructField("actors_completed", T.IntegerType()),
    T.StructField("total_actors", T.IntegerType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("n_updates", T.LongType()),
    T.StructField("completed", T.ArrayType(T.IntegerType())),
    T.StructField("last_seq", T.LongType()),
])


def _conformed(rows: DataFrame) -> DataFrame:
    """Rows with the columns of the state table; what they do not know is null."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in STATUS.fields
    ])


def run_status_stream(
    updates: DataFrame,
    path: str,
    checkpoint: str,
    *,
    stored: DataFrame | None = None,
    available_now: bool = True,
    compact: int = COMPACT,
) -> StreamingQuery:
    """Fold each micro-batch into a state table (``StateTable``), without per-row Python.

    A hot envelope is spread over tasks as in the batch fold. A batch reads the open envelopes
    and writes those it changed; a final state cannot change, so closed ones are written once.
    Creation rows in the stream have ``seq = -1``: the first one of an id counts, also of an id
    that is open or closed already; ``stored`` are envelopes known beforehand. The newest ``ts``
    of a batch is its clock for deadlines. A repeated batch replaces its own version.
    """

    def each(batch: DataFrame, version: int) -> None:
        table = StateTable(batch.sparkSession, path, STATUS, compact=compact)
        line = table.line(version)
        batch = batch.persist()
        open_ = table.open(line)
        if line.version < 0 and stored is not None:
            open_ = _conformed(stored)
        made = F.col("seq") == CREATED_SEQ
        due = F.col("deadline") if "deadline" in batch.columns else F.lit(None).cast("timestamp")
        first = F.min(F.struct("ts", due.alias("deadline"), "actors")).alias("f")
        fresh = batch.filter(made).groupBy(F.col("envelope_id").alias("id")).agg(first).select(
            "id", "f.actors", F.col("f.ts").alias("created_at"), "f.deadline")
        known = table.closed(line).select("id").join(fresh.select("id"), "id", "left_semi")
        fresh = fresh.join(open_.select("id").unionByName(known), "id", "left_anti")
        upd = batch.filter(~made).drop("deadline")
        touched = batch.select(F.col("envelope_id").alias("id")).distinct()
        snap = fold_status(
            open_.join(touched, "id", "left_semi").unionByName(_conformed(fresh)), upd)
        rest = open_.join(touched, "id", "left_anti")
        clock = F.lit(batch.agg(F.max("ts").alias("now")).first()["now"]).cast("timestamp")
        if line.version >= 0:  # the first version holds all that is stored
            rest = rest.filter(is_due(F.col("status"), F.col("deadline"), clock))
        rest = rest.withColumn("status", F.coalesce("status", F.lit("pending")))
        rest = rest.withColumn("progress_percent", F.coalesce("progress_percent", F.lit(0.0)))
        state = expire(snap.select(*STATUS.fieldNames()).unionByName(rest), clock).persist()
        over = is_final(F.col("status"))
        table.commit(version, state.filter(~over), state.filter(over), state.filter(over).select("id"))
        state.unpersist()
        batch.unpersist()

    writer = updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Current state from the table of ``run_status_stream``."""
    return StateTable(spark, path, STATUS).read()


def run_attempts_stream(
    deliveries: DataFrame,
    path: str,
    checkpoint: str,
    *,
    key: str = "id",
    order: str = "seq",
    available_now: bool = True,
    compact: int = COMPACT,
) -> StreamingQuery:
    """Number deliveries per key, in order of micro-batches and of ``order`` within one.

    A key's rows of a batch are numbered in chunks, as in ``attempts``, and added to the number
    the key had reached before, so a hot key is spread over tasks and nothing is held per row.
    Numbered rows go to ``path/rows``, a repeated batch replacing its own.
    """
    counts = T.StructType([deliveries.schema[key], T.StructField("n", T.LongType())])

    def each(batch: DataFrame, version: int) -> None:
        table = StateTable(batch.sparkSession, f"{path}/counts", counts, key, compact)
        before = table.open(table.line(version)).select(
            F.col(key).alias("__key"), F.col("n").alias("__n"))
        batch = batch.persist()
        reached = lambda rows: rows.join(before, F.col(key) == F.col("__key"), "left")
        past = F.coalesce("__n", F.lit(0))
        rows = reached(attempts(batch, key, order)).withColumn("attempt", F.col("attempt") + past)
        rows.drop("__key", "__n").write.mode("overwrite").parquet(f"{path}/rows/batch={version}")
        total = reached(batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
        total = total.select(key, (F.col("n") + past).alias("n"))
        table.commit(version, total, total.limit(0), total.limit(0))
        batch.unpersist()

    writer = deliveries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_dedup_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    *,
    keys: tuple[str, ...] = ("id", "hop"),
    available_now: bool = True,
) -> StreamingQuery:
    """The first row of every key, however far apart its copies arrive.

    The rows kept so far are the memory: a batch looks its own keys up among theirs, which
    reads the key columns only and, by Spark's Bloom filter of the batch's keys, moves few of
    them. No state is held and nothing is forgotten.
    """

    def each(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(list(keys)).persist()
        new = batch
        held = T.StructType([*batch.schema.fields, T.StructField("batch", T.LongType())])
        if version > 0:
            kept = spark.read.schema(held).parquet(path)
            kept = kept.filter(F.col("batch") < version).select(*keys)
            match = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
            seen = kept.alias("a").join(batch.select(*keys).alias("b"), match("a", "b"), "left_semi")
            new = batch.alias("a").join(seen.alias("b"), match("a", "b"), "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={version}")
        batch.unpersist()

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def attempts_stream(deliveries: DataFrame, key: str = "id") -> DataFrame:
    """Deliveries with their attempt number; ``redrive`` then picks the target."""
    out = T.StructType(deliveries.schema.fields + [T.StructField("attempt", T.LongType())])
    return deliveries.groupBy(key).transformWithState(
        statefulProcessor=AttemptCount(), outputStructType=out, outputMode="Append",
        timeMode="None",
    )


def rate_stream(stream: DataFrame, ts: str, by: list[str], window: str = "5 minutes",
                slide: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    """Rows per second over sliding windows, closed by the watermark."""
    counted = (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window, slide), *by)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    length = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return counted.select(
        *by,
        F.col("window.start").alias("window_start"),
        "n",
        (F.col("n") / length.cast("double")).alias("per_second"),
    )


class Tail:
    """Full history of some envelopes, then their new updates, until all are final."""

    def __init__(self, updates: DataFrame, ids: list[str], sink: Callable[[DataFrame], None],
                 checkpoint: str) -> None:
        self._open = set(ids)
        self._sink = sink
        wanted = updates.filter(F.col("envelope_id").isin(*ids))
        self.query: StreamingQuery = (
            wanted.writeStream.foreachBatch(self._each)
            .option("checkpointLocation", checkpoint)
            .start()
        )

    def _each(self, batch: DataFrame, _batch_id: int) -> None:
        self._sink(batch)
        # at most one row per requested id reaches the driver
        ended = batch.filter(is_final(F.col("status"))).select("envelope_id").distinct()
        self._open -= {r[0] for r in ended.collect()}

    def wait(self, timeout: float | None = None, pause: float = 0.2) -> bool:
        """Run until every id is final, or for ``timeout`` seconds; True when all ended."""
        left = timeout
        while self._open and self.query.isActive and (left is None or left > 0):
            self.query.awaitTermination(pause)
            left = None if left is None else left - pause
        self.query.stop()
        return not self._open


def tail(updates: DataFrame, ids: list[str], sink: Callable[[DataFrame], None],
         checkpoint: str) -> Tail:
    """Start a tail over a stream read from its earliest offset."""
    return Tail(updates, ids, sink, checkpoint)
