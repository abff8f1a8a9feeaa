"""Rows put into partition folders of the local file system by the Python workers.

Hadoop's local file system starts a ``chmod`` process for each folder, file and checksum file it
makes, some 8 ms for a folder with one file, which is nearly all that a write into many folders
takes. Here a worker makes them itself. Folders, lines and what a failure leaves are those of
Spark's writer: a task attempt writes beside the table, and the folders of the attempts that
Spark counted move into place when all are through. There are no checksum files.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill.session import stored

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 32), *map(ord, "\"#%'*/:=?\\\x7f{[]^"))}


def folder_name(keys: Sequence[str], values: Sequence[object]) -> str:
    """The folder of some partition values, as Spark names it."""
    return "/".join(
        f"{k}={NO_VALUE if v is None or v == '' else str(v).translate(_ESCAPED)}"
        for k, v in zip(keys, values, strict=True))


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme where it lies on the local file system, else none.

    Names beyond ASCII are left to Spark: which bytes they become is up to the JVM's locale.
    """
    sc = spark.sparkContext
    named = sc._jvm.org.apache.hadoop.fs.Path(path)
    full = named.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(named).toUri()
    return full.getPath() if full.getScheme() == "file" and full.getPath().isascii() else None


def put_rows(frame: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Write rows as JSON lines to a local path by ``keys``, in place of what was there.

    Returns the id and the keys of every row that was written.
    """
    work = f"{os.path.dirname(place)}/_temporary-{uuid.uuid4().hex}"
    values = [c for c in frame.columns if c not in keys]
    lines = frame.sortWithinPartitions(*keys).select(
        "id", *keys,
        F.to_json(F.array(*[F.col(k).cast("string") for k in keys])).alias("__folder"),
        F.concat(F.to_json(F.struct(*values)), F.lit("\n")).cast("binary").alias("__line"),
    )
    told = T.StructType([T.StructField(k, frame.schema[k].dataType) for k in ("id", *keys)])
    told = told.add("__attempt", "long").add("__left", "binary")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _put(batches, tuple(keys), work)

    try:
        rows = stored(lines.mapInArrow(put, told), "objects")
        attempts, left = rows.agg(F.collect_set("__attempt"), F.count("__left")).first()
        if os.path.exists(place):
            shutil.rmtree(place)
        os.makedirs(place)
        for attempt in attempts:
            _merge(f"{work}/{attempt}", place)
    finally:
        shutil.rmtree(work, ignore_errors=True)
    if left:
        line = F.from_json(F.col("__left").cast("string"), frame.select(*values).schema)
        rows.filter(F.col("__left").isNotNull()).select(*keys, line.alias("__row")).select(
            "__row.*", *keys).write.mode("append").partitionBy(*keys).json(f"file:{place}")
    open(f"{place}/_SUCCESS", "w").close()
    return rows.drop("__attempt", "__left")


def _put(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], work: str
         ) -> Iterator[pa.RecordBatch]:
    """Write the lines of sorted rows, a file per folder; rows of other folders are handed back."""
    task = TaskContext.get()
    attempt, stem = task.taskAttemptId(), f"part-{task.partitionId():05d}-{uuid.uuid4()}"
    out, last, n = None, None, 0
    try:
        for batch in batches:
            line, runs = batch.column("__line"), pc.run_end_encode(batch.column("__folder"))
            wide = np.int64 if pa.types.is_large_binary(line.type) else np.int32
            at = np.frombuffer(line.buffers()[1], wide)[line.offset:line.offset + len(line) + 1]
            data, begin, written = memoryview(line.buffers()[2]), 0, []
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if key != last:
                    if out is not None:
                        out.close()
                    folder, out, last = folder_name(keys, json.loads(key)), None, key
                    if folder.isascii():
                        os.makedirs(f"{work}/{attempt}/{folder}", exist_ok=True)
                        out = open(f"{work}/{attempt}/{folder}/{stem}.c{n:03d}.json", "wb")
                        n += 1
                if out is not None:
                    out.write(data[at[begin]:at[end]])
                written.append(np.full(end - begin, out is not None))
                begin = end
            here = pa.array(np.concatenate(written) if written else np.empty(0, bool))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[batch.column(k) for k in keys],
                 pc.if_else(here, pa.scalar(attempt, pa.int64()), pa.scalar(None, pa.int64())),
                 pc.if_else(here, pa.scalar(None, line.type), line)],
                names=["id", *keys, "__attempt", "__left"])
    finally:
        if out is not None:
            out.close()


def _merge(source: str, target: str) -> None:
    """Move what lies in a folder into another, whole folders where it has none of the name."""
    with os.scandir(source) as entries:
        for entry in entries:
            to = f"{target}/{entry.name}"
            if entry.is_dir() and os.path.isdir(to):
                _merge(entry.path, to)
            else:
                os.rename(entry.path, to)
