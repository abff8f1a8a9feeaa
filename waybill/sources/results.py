"""Terminal result objects: JSON files under terminal/date/hour/last_actor."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.operators.terminal import to_error
from waybill.schema import ENVELOPE
from waybill.session import stored
from waybill.sources.folders import folder_name, local_path, put_rows

PARTITIONS = ("terminal", "date", "hour", "last_actor")
INDEX = "-index"  # beside the folder of the objects
FOLDERS = 1000  # folders that a lookup names one by one
KEYS = ("batch", *PARTITIONS)  # folders of a batch's rows
DAY = KEYS[:3]


def _schema() -> T.StructType:
    fields = [*ENVELOPE.fields, T.StructField("finished_at", T.TimestampType())]
    return T.StructType(
        fields
        + [
            T.StructField("terminal", T.StringType()),
            T.StructField("date", T.DateType()),
            T.StructField("hour", T.IntegerType()),
            T.StructField("last_actor", T.StringType()),
        ]
    )


def _ended(rows: DataFrame) -> Column:
    """When a row's last call ended, as its trace says; the time of writing without one."""
    if "trace" not in rows.columns:
        return F.current_timestamp()
    last = F.try_element_at("trace", F.lit(-1))
    micros = F.unix_micros(last["started_at"]) + F.coalesce(
        F.round(last["duration_s"] * 1e6).cast("bigint"), F.lit(0))
    return F.coalesce(F.timestamp_micros(micros), last["enqueued_at"], F.current_timestamp())


def write_terminal(
    done: DataFrame, base: str, *, mode: str = "append", compact: bool = False,
    batch: str | None = None, index: bool = False, **parts
) -> None:
    """Persist terminal rows whole. ``finished_at`` is the end of the row's last call unless given.

    With ``batch`` the rows go to a folder of that name, and the same batch written again
    replaces it as a whole, in whatever hours its first attempt ended. ``index`` also writes
    where each id is (``read_terminal`` then opens those folders only); on a local file system
    the Python workers make its folders (``put_rows``). ``compact`` trades one shuffle for fewer
    and evenly sized files. Extra keyword values become leading partition columns.
    """
    rows = to_error(done)
    if "finished_at" not in rows.columns:
        rows = rows.withColumn("finished_at", _ended(rows))
    at = F.col("finished_at")
    named = [F.lit(v).alias(k) for k, v in parts.items()]
    frame = rows.select(
        *named,
        *[f.name for f in ENVELOPE.fields],
        "finished_at",
        "terminal",
        F.to_date(at).alias("date"),
        F.hour(at).alias("hour"),
        "last_actor",
    )
    if compact:
        frame = frame.hint("rebalance", *PARTITIONS)
    writer, place = frame.write.mode(mode), base
    if batch is not None:
        writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "static")
        place = f"{base}/batch={batch}"
    indexed = index and batch is not None and not parts
    local = local_path(done.sparkSession, place) if indexed else None
    if local is not None:
        _write_index(put_rows(frame, PARTITIONS, local), base, batch)
        return
    writer.partitionBy(*parts, *PARTITIONS).json(place)
    if index:
        if not indexed:
            raise ValueError("an index needs a batch, and no other leading partitions")
        # read back from what was written, once
        written = done.sparkSession.read.schema(_schema()).json(place).select("id", *PARTITIONS)
        _write_index(stored(written, "objects"), base, batch)


def _write_index(written: DataFrame, base: str, batch: str) -> None:
    """Where the ids of a batch are, in order of the ids: the bounds that parquet keeps then skip
    most of an index for one id or one prefix."""
    # an empty name is a folder without a value, as it is read back
    keys = [F.nullif(k, F.lit("")).alias(k) if k in ("terminal", "last_actor") else k for k in PARTITIONS]
    # ids that start alike stay together
    spread = written.select("id", *keys).repartitionByRange("id").sortWithinPartitions("id")
    spread.write.mode("overwrite").parquet(f"{base}{INDEX}/batch={batch}")


def read_terminal(
    spark: SparkSession,
    base: str,
    id: str | None = None,
    *,
    prefix: str | None = None,
    terminal: str | None = None,
    index: bool = False,
) -> DataFrame:
    """Stored terminal rows, of one id, of ids with a prefix, or of one terminal.

    With ``index`` (written with the rows) ids are looked up first, and only the folders that
    hold some are listed and opened: they are named in the plan up to ``FOLDERS`` of them. Beyond,
    the days that hold some are listed (all days above ``FOLDERS`` of them), and the folders are
    joined, so that Spark prunes them while it runs.
    """
    wanted = []
    if terminal is not None:
        wanted.append(F.col("terminal") == terminal)
    if id is not None:
        wanted.append(F.col("id") == id)
    if prefix is not None:
        wanted.append(F.col("id").startswith(prefix))
    if index and (id is not None or prefix is not None):
        rows = _in_folders(spark, base, wanted).drop("batch")
    else:
        schema = _schema()
        rows = spark.read.schema(schema.add("batch", "string") if index else schema).json(base)
    for test in wanted:
        rows = rows.filter(test)
    return rows


def _in_folders(spark: SparkSession, base: str, wanted: list[Column]) -> DataFrame:
    """The rows of the folders in which the index has wanted ids; no other folder is listed."""
    types = _schema().add("batch", "string")
    found = spark.read.schema(T.StructType([types[k] for k in ("id", *KEYS)])).parquet(f"{base}{INDEX}")
    for test in wanted:
        found = found.filter(test)
    folders = found.select(*KEYS).distinct()
    few = folders.limit(FOLDERS + 1).collect()
    if len(few) > FOLDERS:
        days = folders.select(*DAY).distinct().limit(FOLDERS + 1).collect()
        rows = _open(spark, base, DAY, days if len(days) <= FOLDERS else [])
        return rows.join(folders, list(KEYS), "left_semi")
    if not few:
        return spark.createDataFrame([], types)
    rows = _open(spark, base, KEYS, few)
    # one flat list of folders: a chain of conditions would be as deep as there are folders
    each = [F.struct(*[F.lit(r[k]).cast(types[k].dataType).alias(k) for k in KEYS]) for r in few]
    return rows.filter(F.struct(*KEYS).isin(each))


def _open(spark: SparkSession, base: str, keys: tuple[str, ...], few: list[Row]) -> DataFrame:
    """The rows below some folders, or all rows without any."""
    reader = spark.read.schema(_schema().add("batch", "string"))
    try:
        named = [f"{base}/{folder_name(keys, r)}" for r in few]
        return reader.option("basePath", base).json(named or base)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return reader.json(base)  # an index older than its rows names folders that are gone
