"""Keyed state as a table of small changes that is merged when it is read.

A micro-batch writes only the keys it changed (``changes/version=N``), so a write costs what
the batch changed. Every ``COMPACT`` versions the open state is written anew as a base, into
the other one of two slots: writing a slot removes what it held, so the table keeps the state
of two bases and the changes since, however many batches there were. Rows that cannot change
any more go to ``closed/version=N`` once and are not read by later batches except by key.

The last step of a batch is its line in ``manifest/``: base, slot and version. Readers follow the
newest line and look at nothing beyond it, so a batch that failed half-way does not show. A
repeated batch starts from the line before its own and replaces its own files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPACT = 16
LINES = 64  # lines of the manifest that are kept

_LINE = "version bigint, slot int, base bigint"
VERSION, GONE = "__version", "__gone"


@dataclass(frozen=True)
class Line:
    """What a reader may see: a slot with its base, and versions up to this one."""

    version: int = -1
    slot: int = 0
    base: int = -1


class StateTable:
    """State of keys (column ``key``) with rows of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id",
                 compact: int = COMPACT):
        if not 0 < compact < LINES:
            raise ValueError(f"compact must lie between 1 and {LINES - 1}")
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.compact = compact

    def line(self, before: int | None = None) -> Line:
        """The newest line of the manifest, or the newest below a version."""
        lines = self._read("manifest", T.StructType.fromDDL(_LINE))
        if before is not None:
            lines = lines.filter(F.col("version") < before)
        newest = lines.orderBy(F.desc("version")).limit(1).collect()
        return Line(*newest[0][:3]) if newest else Line()

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        """Rows of a folder; none where it is not there yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _slot(self, line: Line) -> DataFrame:
        """The open state of a line: of every key the newest row, unless it has gone."""
        held = T.StructType([*self.schema.fields, T.StructField(VERSION, T.LongType()),
                             T.StructField(GONE, T.BooleanType())])
        rows = self._read(f"open{line.slot}", held).filter(
            F.col(VERSION).between(line.base, line.version))
        newest = F.max_by(F.struct(*[f.name for f in self.schema.fields if f.name != self.key], GONE),
                          F.col(VERSION)).alias("s")
        state = rows.groupBy(self.key).agg(newest).select(self.key, "s.*")
        return state.filter(~F.col(GONE)).select(*self.schema.fieldNames())

    def open(self, line: Line | None = None) -> DataFrame:
        """Rows that may still change."""
        line = self.line() if line is None else line
        if line.version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self._slot(line)

    def closed(self, line: Line | None = None) -> DataFrame:
        """Rows that cannot change any more."""
        line = self.line() if line is None else line
        held = T.StructType([*self.schema.fields, T.StructField(VERSION, T.LongType())])
        rows = self._read("closed", held).filter(F.col(VERSION) <= line.version)
        return rows.select(*self.schema.fieldNames())

    def read(self) -> DataFrame:
        """All rows, as of the newest line."""
        line = self.line()
        return self.open(line).unionByName(self.closed(line))

    def commit(self, version: int, changed: DataFrame, closed: DataFrame, gone: DataFrame) -> Line:
        """Write a version: changed open rows, rows closed by it, and keys that are not open
        any more. The new state shows when the manifest has its line, which is written last."""
        line = self.line(version)
        names = self.schema.fieldNames()
        dead = gone.select(
            *[(F.col(n) if n == self.key else F.lit(None)).cast(self.schema[n].dataType).alias(n)
              for n in names], F.lit(True).alias(GONE))
        rows = changed.select(*names, F.lit(False).alias(GONE)).unionByName(dead)
        closed.select(*names, F.lit(version).cast("bigint").alias(VERSION)).write.mode(
            "overwrite").parquet(f"{self.path}/closed/part={version}")
        rows.withColumn(VERSION, F.lit(version).cast("bigint")).write.mode("overwrite").parquet(
            f"{self.path}/open{line.slot}/part={version}")
        now = Line(version, line.slot, line.base)
        if version - max(line.base, 0) >= self.compact:
            other = 1 - line.slot
            base = self._slot(now).select(
                *names, F.lit(version).cast("bigint").alias(VERSION), F.lit(False).alias(GONE),
                F.lit(version).alias("part"))
            # the whole slot is replaced: older bases and their changes go
            base.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
                "part").parquet(f"{self.path}/open{other}")
            now = Line(version, other, version)
        self.spark.createDataFrame([(now.version, now.slot, now.base)], _LINE).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/manifest/part={version % LINES}")
        return now
