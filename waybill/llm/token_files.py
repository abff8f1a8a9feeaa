"""Token ids in raw files, found by a minimal perfect hash of the document keys.

A shard is three files: ``.ids`` (the ids of its documents one after the other, two or
four bytes each), ``.idx`` (the hash, and per slot a fingerprint, offset and length) and
``.keys`` (keys in file order, for scans). Documents are range-partitioned and sorted by
key, so shards follow each other in ascending key order. A shard is closed at
``shard_ids`` ids or ``SHARD_KEYS`` documents, which bounds what a task holds.

The hash has levels: a level's bit is set where exactly one of its remaining keys falls;
the others go on to the next level. The number of set bits before a key's bit is its
slot. A key that was never stored reaches no bit or a slot with another fingerprint.

Defined results: a null text is an empty document; an empty table gives no shards; rows
that repeat a key are all written and scanned, keyed access finds the first; rows with a
null key are written first and scanned, keyed access does not reach them; other columns
are not carried.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import column
from waybill.llm.files import attempt_name, create, read
from waybill.llm.tokens import encoder
from waybill.session import stored

SHARD_IDS = 1 << 24
SHARD_KEYS = 1 << 20
LEVELS = 48


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys, mixed with a salt."""
    x = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Slots 0..n-1 for n distinct keys. ``words`` holds the bits of all levels, ``sizes``
    the bits of each level, ``ranks`` the set bits before each word."""

    words: np.ndarray
    sizes: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, words, sizes = keys, [], []
        while left.size:
            if len(sizes) == LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            size = -(-max(64, int(gamma * left.size)) // 64) * 64
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        words = np.concatenate(words) if words else np.zeros(0, "<u8")
        counts = np.bitwise_count(words).astype(np.uint32)
        ranks = np.cumsum(counts, dtype=np.uint32) - counts
        return cls(words, np.array(sizes, np.int64), ranks.astype(np.uint32))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it."""
        out = np.full(len(keys), -1, np.int64)
        left, before = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + before
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            left, before = left[~hit], before + size
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """Index of distinct keys: hash, fingerprints, offsets and lengths by slot."""
    table = PerfectHash.build(keys)
    slot = table.slots(keys)
    by_slot = np.empty(len(keys), np.int64)
    by_slot[slot] = np.arange(len(keys))
    out = io.BytesIO()
    np.savez(
        out, words=table.words, sizes=table.sizes, ranks=table.ranks,
        fingerprints=fingerprint(keys)[by_slot], starts=starts[by_slot], lengths=lengths[by_slot],
    )
    return out.getvalue()


class Shard:
    """Keyed access to one shard's files."""

    def __init__(self, path: str, dtype: str):
        self.path, self.dtype = path, dtype
        with read(path + ".idx") as f:
            parts = np.load(io.BytesIO(f.read()), allow_pickle=False)
        self.hash = PerfectHash(parts["words"], parts["sizes"], parts["ranks"])
        self.fingerprints = parts["fingerprints"]
        self.starts, self.lengths = parts["starts"], parts["lengths"]

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length in ids of each key, -1 where it is not stored."""
        slot = self.hash.slots(keys)
        if not len(self.starts):
            return np.full(len(keys), -1), np.full(len(keys), -1)
        found = (slot >= 0) & (self.fingerprints[slot] == fingerprint(keys))
        return np.where(found, self.starts[slot], -1), np.where(found, self.lengths[slot], -1)

    def payload(self) -> np.ndarray:
        with read(self.path + ".ids") as f:
            return np.frombuffer(f.read(), dtype=self.dtype)

    def get(self, key: int) -> np.ndarray | None:
        start, length = (int(x[0]) for x in self.locate(np.array([key], np.int64)))
        return None if start < 0 else self.payload()[start : start + length]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in file order, which of them are null, and the lengths."""
        with read(self.path + ".keys") as f:
            parts = np.load(io.BytesIO(f.read()), allow_pickle=False)
        return parts["keys"], parts["null"], parts["lengths"]


MANIFEST = (
    "part int, seq int, path string, dtype string, n_docs bigint, n_ids bigint, "
    "first_key bigint, last_key bigint"
)


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Write the shards and return their manifest, in key order by (part, seq), with
    ``first_id``: the ids of all shards before. ``key`` is an integer column."""
    rows = docs.select(column(key).cast("bigint").alias("key"), column(text).alias("text"))
    # the text's hash splits a key that very many rows repeat
    ordered = (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("key", "tie")
        .sortWithinPartitions("key", "tie")
        .select("key", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = enc.pack([end_id])
        width = np.dtype(enc.dtype).itemsize
        part, seq = TaskContext.get().partitionId(), 0
        path, sink, keys, lengths, size = "", None, [], [], 0

        def close():
            sink.close()
            null = np.array([k is None for k in keys])
            ks = np.array([0 if k is None else k for k in keys], np.int64)
            ns = np.array(lengths, np.int64)
            starts = np.cumsum(ns) - ns
            some = ks[~null]
            _, first = np.unique(some, return_index=True)
            first.sort()
            with create(path + ".idx") as f:
                f.write(index_bytes(some[first], starts[~null][first], ns[~null][first]))
            listed = io.BytesIO()
            np.savez(listed, keys=ks, null=null, lengths=ns)
            with create(path + ".keys") as f:
                f.write(listed.getvalue())
            first_key, last_key = (int(some[0]), int(some[-1])) if len(some) else (None, None)
            row = {
                "part": part, "seq": seq, "path": path, "dtype": enc.dtype, "n_docs": len(keys),
                "n_ids": size, "first_key": first_key, "last_key": last_key,
            }
            return pa.RecordBatch.from_pylist([row], schema=manifest_schema)

        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text")):
                if sink is None:
                    path = attempt_name(folder, "")
                    sink, keys, lengths, size = create(path + ".ids"), [], [], 0
                ids = enc.encode(t.as_py() or "") + end
                sink.write(ids)
                keys.append(k)
                lengths.append(len(ids) // width)
                size += lengths[-1]
                if size >= shard_ids or len(keys) >= SHARD_KEYS:
                    yield close()
                    sink, seq = None, seq + 1
        if sink is not None:
            yield close()

    manifest_schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("dtype", pa.string()),
        ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()),
        ("last_key", pa.int64()),
    ])
    shards = stored(ordered.mapInArrow(write, MANIFEST), "id-shards")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    first_id = F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("bigint")
    return shards.withColumn("first_id", first_id)


def read_ids(manifest: DataFrame) -> DataFrame:
    """Every document of the shards by keyed access: (key, start, n_ids, ids), ids as
    little-endian unsigned 32-bit. Repeated and null keys are read by their place."""
    shards = stored(manifest.select("path", "dtype", "first_id"), "id-manifest")
    spread = shards.repartition(max(1, shards.count()), "path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["path"], row["dtype"])
                keys, null, lengths = shard.keys()
                place = np.cumsum(lengths) - lengths
                start, length = shard.locate(keys)
                if not len(keys):
                    continue
                repeated = np.zeros(len(keys), bool)
                repeated[1:] = keys[1:] == keys[:-1]
                by_place = null | repeated
                start = np.where(by_place, place, start)
                length = np.where(by_place, lengths, length)
                if (start < 0).any():
                    raise ValueError(f"a stored key is not found in {row['path']}")
                payload = shard.payload()
                for at in range(0, len(keys), 1000):
                    part = slice(at, at + 1000)
                    ids = [
                        payload[s : s + n].astype("<u4").tobytes()
                        for s, n in zip(start[part].tolist(), length[part].tolist())
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[part], mask=null[part]),
                            pa.array(start[part] + row["first_id"], pa.int64()),
                            pa.array(length[part], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        names=["key", "start", "n_ids", "ids"],
                    )

    return spread.mapInArrow(scan, "key bigint, start bigint, n_ids bigint, ids binary")
