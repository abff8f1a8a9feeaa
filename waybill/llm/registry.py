"""Queries of this folder: name -> callable, and name -> SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waybill.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


# rows of an Arrow batch: texts may be long, so batches stay small
BATCH_ROWS = "1000"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators of this folder rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def query(name: str, sql: str | None = None):
    def register(fn):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        call.__doc__ = fn.__doc__
        QUERIES[name] = call
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
