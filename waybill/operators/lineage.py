"""Lineage of fanned-out envelopes, and duplicate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators.scan import Running, running
from waybill.session import cut_lineage


def children(df: DataFrame) -> DataFrame:
    """Every child next to its parent."""
    parent = df.select(F.col("id").alias("parent_id"), F.struct("*").alias("parent"))
    return df.filter(F.col("parent_id").isNotNull()).join(parent, "parent_id")


def family(df: DataFrame) -> DataFrame:
    """Root and depth of every envelope, over any number of fan-outs.

    Pointer jumping: each round joins every open row to where its pointer leads
    and so doubles the distance; depth d takes log2(d) rounds. Every round is
    checkpointed, and finished rows leave the loop. A row that has come further than there
    are rows goes round in a cycle; such rows have no root, and there is no other limit.
    """
    chained = F.col("up").isNotNull()
    links = df.select(
        "id",
        F.col("parent_id").alias("up"),
        F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
    )
    settled = links.filter(~chained).select("id", F.col("id").alias("root"), "steps")
    open_ = links.filter(chained)
    rows, distance = None, 1
    while True:
        target = links.select(
            F.col("id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more")
        )
        joined = cut_lineage(open_.join(target, "up", "left"))
        ends = F.col("further").isNull()
        settled = settled.unionByName(
            joined.filter(ends).select("id", F.col("up").alias("root"), "steps")
        )
        open_ = joined.filter(~ends).select(
            "id", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps")
        )
        if open_.isEmpty():
            break
        distance *= 2
        rows = df.count() if rows is None else rows
        if distance > rows:
            break
        done = settled.select(
            "id", F.when(F.col("id") != F.col("root"), F.col("root")).alias("up"), "steps"
        )
        links = done.unionByName(open_)
    cyclic = open_.select("id", F.lit(None).cast("string").alias("root"), "steps")
    return settled.unionByName(cyclic).withColumnRenamed("steps", "depth")


def fanout_width(df: DataFrame) -> DataFrame:
    """Outputs per fanned-out envelope, the parent included."""
    return df.groupBy(F.coalesce("parent_id", "id").alias("origin")).agg(
        F.count(F.lit(1)).alias("width")
    )


def reject_duplicates(
    new: DataFrame, existing: DataFrame, order: str, chunk: Column
) -> tuple[DataFrame, DataFrame]:
    """New rows as (accepted, rejected): the first of an id wins, stored ids are taken."""
    seen = running(
        new, ["id"], [order], chunk, __seen=Running("max", F.lit(1), before=True)
    )
    taken = existing.select("id").distinct().withColumn("__taken", F.lit(True))
    marked = seen.join(taken, "id", "left")
    clash = F.col("__seen").isNotNull() | F.col("__taken").isNotNull()
    out = marked.withColumn("__clash", clash)
    columns = new.columns
    return (
        out.filter(~F.col("__clash")).select(*columns),
        out.filter("__clash").select(*columns),
    )


def id_collisions(df: DataFrame) -> DataFrame:
    """Ids minted more than once."""
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
