"""Packing documents into fixed windows by best-fit decreasing.

Each task packs the documents it reads, so nothing is shuffled. Documents longer than
a window are first cut into full windows; what is left of them, and shorter documents,
are gathered into blocks of ``block`` pieces, sorted by length and put into the tightest
open window. A segment tree over the remaining capacities finds it in log(window) steps.
A task holds one document and the ids of one block, at most a window each; it hands on
``HANDED`` pieces at a time, and full windows as soon as there are so many.

Defined results: a null text is an empty document of one end token; an empty table gives
no rows; rows that repeat a key are packed as documents of their own; other columns are
not carried. Sequence ids are unique over the whole result; they depend on how Spark
splits the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waybill.llm.common import column
from waybill.llm.tokens import Encoder, encoder

WINDOW = 1024
BLOCK = 8192
HANDED = 256  # pieces of an Arrow batch


class OpenWindows:
    """Open windows by remaining capacity; a segment tree counts those of each range."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def push(self, capacity: int, window: int) -> None:
        if capacity:
            self.open[capacity].append(window)
            self._add(capacity, 1)

    def tightest(self, length: int) -> int | None:
        """Smallest capacity of at least ``length`` that some open window has."""
        node = length + self.size
        if self.count[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None

    def pop(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """(window, offset) of every piece, longest first, and the number of windows."""
    place, offset = [0] * len(lengths), [0] * len(lengths)
    tree, n = OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        capacity = tree.tightest(lengths[i])
        if capacity is None:
            capacity, chosen, n = window, n, n + 1
        else:
            chosen = tree.pop(capacity)
        place[i], offset[i] = chosen, window - capacity
        tree.push(capacity - lengths[i], chosen)
    return place, offset, n


PIECES = (
    ("start", pa.int64(), T.LongType()),
    ("length", pa.int64(), T.LongType()),
    ("ids", pa.binary(), T.BinaryType()),
    ("doc_tokens", pa.int64(), T.LongType()),
    ("sequence_id", pa.int64(), T.LongType()),
    ("offset", pa.int64(), T.LongType()),
)


def packed_batches(
    batches: Iterator[pa.RecordBatch], enc: Encoder, base: int, window: int, end_id: int, block: int
) -> Iterator[pa.RecordBatch]:
    """The pieces of (key, text) batches; sequences are numbered from ``base`` on."""
    end = np.array([end_id], dtype="<u4")
    made = 0

    def rows(pieces, places):
        for at in range(0, len(pieces), HANDED):
            some, where = pieces[at : at + HANDED], places[at : at + HANDED]
            keys, starts, ids, tokens = zip(*some)
            rest = (starts, [len(x) // 4 for x in ids], ids, tokens,
                    [base + s for s, _ in where], [o for _, o in where])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type),
                 *[pa.array(v, t) for v, (_, t, _) in zip(rest, PIECES)]],
                names=["key", *[n for n, _, _ in PIECES]],
            )

    def whole_windows(pieces):
        nonlocal made
        made += len(pieces)
        yield from rows(pieces, [(made - len(pieces) + i, 0) for i in range(len(pieces))])

    def packed(pieces):
        nonlocal made
        place, offset, n = best_fit([len(p[2]) // 4 for p in pieces], window)
        first, made = made, made + n
        yield from rows(pieces, [(first + s, o) for s, o in zip(place, offset)])

    # pieces hold ids of their own: a view would keep its document's
    pool, full, key_type = [], [], None
    for batch in batches:
        key_type = batch.schema.field("key").type
        for k, t in zip(batch.column("key").to_pylist(), batch.column("text")):
            ids = np.frombuffer(enc.encode(t.as_py() or ""), dtype=enc.dtype).astype("<u4")
            ids = np.concatenate([ids, end])
            whole = len(ids) // window * window
            for at in range(0, whole, window):
                full.append((k, at, ids[at : at + window].tobytes(), len(ids)))
                if len(full) == HANDED:
                    yield from whole_windows(full)
                    full = []
            if whole < len(ids):
                pool.append((k, whole, ids[whole:].tobytes(), len(ids)))
                if len(pool) == block:
                    yield from packed(pool)
                    pool = []
    if full:
        yield from whole_windows(full)
    if pool:
        yield from packed(pool)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = 0,
    block: int = BLOCK,
) -> DataFrame:
    """One row per piece: key, start in its document, length, ids (little-endian unsigned
    32-bit), the document's tokens, sequence and offset there."""
    kept = docs.select(column(key).alias("key"), column(text).cast("string").alias("text"))
    schema = T.StructType(
        [T.StructField("key", kept.schema["key"].dataType)]
        + [T.StructField(n, t) for n, _, t in PIECES]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        yield from packed_batches(batches, encoder(tokenizer), base, window, end_id, block)

    return kept.mapInArrow(run, schema).withColumnRenamed("key", key)
