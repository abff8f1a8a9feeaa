"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector a key of ``BITS`` random hyperplane signs, orders all vectors by
that key, and compares each with the ``WINDOW`` before it, so nearby directions meet whatever
the size of a bucket would be. A range-partitioned sort deals the rows out, also those of one
very common direction. ``PASSES`` independent passes run side by side. Of the verified pairs
a task writes only those that connect something new in its window, and the union of all
passes gives the components.

Link counts are exact within a component: its vectors are gathered into blocks of about
``BLOCK`` and blocks meet blocks, which yields one count per vector and never the pairs.

Defined results: null ids are returned as they are, linked with nothing (component null);
vectors that are null, empty, zero, or hold null or non-finite components are components of
their own; vectors of different lengths never link; rows that repeat an id are one vector
(the smallest of them) and one row of the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import column
from waybill.llm.components import components
from waybill.session import stored

COSINE = 0.9
PASSES, BITS, WINDOW, BLOCK = 24, 48, 64, 128


def _usable(rows: DataFrame) -> DataFrame:
    """(id, raw, dim): vectors as bytes of 64-bit floats, those that can link."""
    v = F.col("vector")
    fine = (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ) & F.exists(v, lambda x: x != 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(x, "<f8") for x in batch.column("vector").to_pylist()]
            # scaled first, so that squares neither overflow nor vanish
            scaled = [x / np.abs(x).max() for x in vectors]
            raw = [(x / np.sqrt(x @ x)).tobytes() for x in scaled]
            dim = pa.array([len(x) for x in vectors], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), dim, pa.array(raw, pa.binary())], names=["id", "dim", "raw"]
            )

    return rows.filter(v.isNotNull() & fine).mapInArrow(pack, "id bigint, dim int, raw binary")


def _with_keys(vectors: DataFrame, passes: int) -> DataFrame:
    """One row per vector and pass: (pass, dim, key, id, raw)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_pylist()
            out = []
            for dim, raw in zip(dims, batch.column("raw").to_pylist()):
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).standard_normal((passes * BITS, dim))
                signs = (planes[dim] @ np.frombuffer(raw, "<f8") > 0).reshape(passes, BITS)
                out.append((signs @ weights).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.list_(pa.int64()))],
                names=["id", "dim", "raw", "keys"],
            )

    keyed = vectors.mapInArrow(keys, "id bigint, dim int, raw binary, keys array<bigint>")
    return keyed.select(F.posexplode("keys").alias("pass", "key"), "dim", "id", "raw")


class _Sets:
    """Union-find over the ids of a window."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.root[a] = b
        return a != b


def window_links(keyed: DataFrame, cosine: float, window: int) -> DataFrame:
    """Verified links (a, b) between neighbours in key order, enough to connect them."""
    order = ["pass", "dim", "key", "id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            run = batch.column("pass").to_numpy().astype(np.int64)
            dims, ids = batch.column("dim").to_numpy(), batch.column("id").to_numpy()
            raw, a, b, at = batch.column("raw").to_pylist(), [], [], 0
            sets = _Sets()
            while at < len(ids):  # rows of one pass and dimension
                same = (run[at:] == run[at]) & (dims[at:] == dims[at])
                end = at + (len(same) if same.all() else int(np.argmin(same)))
                kind = (int(run[at]), int(dims[at]))
                mat = np.frombuffer(b"".join(raw[at:end]), "<f8").reshape(end - at, -1)
                names = ids[at:end]
                if held is not None and held[0] == kind:
                    names, mat = np.concatenate([held[1], names]), np.concatenate([held[2], mat])
                first = len(names) - (end - at)
                for low in range(first, len(names), window):
                    back = max(0, low - window)
                    cos = mat[low : low + window] @ mat[back : low + window].T
                    i, j = np.nonzero(cos >= cosine)
                    i, j = i + low, j + back
                    near = (j < i) & (j >= i - window)
                    for x, y in zip(names[i[near]].tolist(), names[j[near]].tolist()):
                        if sets.join(x, y):
                            a.append(x)
                            b.append(y)
                held, at = (kind, names[-window:], mat[-window:]), end
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}
            )

    # the passes after each other: every one has its own ranges of keys
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("pass", "dim", "id", "raw").mapInArrow(compare, "a bigint, b bigint")


def link_counts(vectors: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(id, n_links) of the vectors that have a component: exact counts, by blocks."""
    sizes = classes.groupBy(F.col("component").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    named = classes.join(sizes, F.col("component") == F.col("__of")).select(
        F.col("node").alias("__node"),
        "component",
        F.pmod(F.xxhash64("node"), F.ceil(F.col("__n") / BLOCK)).alias("block"),
    )
    rows = vectors.join(named, F.col("id") == F.col("__node"))
    blocks = rows.groupBy("component", "dim", "block").agg(
        F.collect_list(F.struct("id", "raw")).alias("rows")
    )
    blocks = stored(blocks.withColumn("__row", F.monotonically_increasing_id()), "blocks")
    other = blocks.select(
        F.col("component").alias("__c"), F.col("dim").alias("__d"), F.col("rows").alias("others")
    )
    met = blocks.join(other, (F.col("component") == F.col("__c")) & (F.col("dim") == F.col("__d")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(rows):
            mat = np.frombuffer(b"".join(r["raw"] for r in rows), "<f8")
            return np.array([r["id"] for r in rows]), mat.reshape(len(rows), -1)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                (ids, x), (others, y) = parts(row["rows"]), parts(row["others"])
                near = (x @ y.T >= cosine) & (ids[:, None] != others[None, :])
                yield pa.RecordBatch.from_pydict({"id": ids, "n": near.sum(axis=1, dtype=np.int64)})

    counted = met.select("rows", "others").mapInArrow(count, "id bigint, n bigint")
    return counted.groupBy("id").agg(F.sum("n").alias("n_links"))


def near_vectors(
    table: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    cosine: float = COSINE,
    passes: int = PASSES,
    window: int = WINDOW,
) -> DataFrame:
    """(key, n_links, component_id, kept) per vector."""
    rows = table.select(column(key).cast("bigint").alias("id"), column(vector).alias("vector"))
    named = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    named = stored(named, "vectors")
    vectors = stored(_usable(named), "unit-vectors")
    links = window_links(_with_keys(vectors, passes), cosine, window)
    classes = stored(components(links), "components")
    counts = link_counts(vectors, classes, cosine)
    of = classes.select(F.col("node").alias("__node"), "component")
    counts = counts.withColumnRenamed("id", "__id")
    found = (
        named.select("id")
        .join(of, F.col("id") == F.col("__node"), "left")
        .join(counts, F.col("id") == F.col("__id"), "left")
        .select(
            F.col("id").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.col(key) == F.col("component_id"))
    )
    null = rows.filter("id IS NULL").select(
        F.col("id").alias(key),
        F.lit(0).cast("bigint").alias("n_links"),
        F.lit(None).cast("bigint").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    return found.unionByName(null)
