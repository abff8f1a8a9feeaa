"""Connected components of links, by alternating large and small stars.

Every round links each node's neighbours to the smallest of them. All steps are group
minima (combined on the map side) and joins that Spark may split where a node has very
many links. Rounds are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.session import stored


def _star(rows: DataFrame) -> DataFrame:
    """Rows (u, v) with the smallest v of their u, or u itself, as m."""
    low = rows.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m"))
    return rows.join(low, F.col("u") == F.col("__u")).select(
        "u", "v", F.least("u", "__m").alias("m")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); component is its smallest node."""
    a, b = F.col("a"), F.col("b")
    edges = links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stored(edges.distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large.filter("u <> v").distinct())
        edges = small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        edges = stored(edges.distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
