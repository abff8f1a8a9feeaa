"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles.

1. Document frequencies. Shingles of five words are counted per document in ``COUNTERS``
   hashed counters, over all documents. The table has a fixed size (4 MB), so it is the one
   thing that is broadcast. Collisions only set a ceiling on N/df, about counters / shingles
   per document, which does not depend on the size of the corpus.
2. Samples. A shingle weighs tf * idf. Improved consistent weighted sampling draws
   ``BANDS * ROWS`` samples per document; two documents agree in one with a probability of
   their weighted Jaccard similarity. Equal texts are one class from here on.
3. Candidates. The samples of a band form a key. Within the documents of a key each one is
   paired with the smallest (a star) and with its neighbour in the order of the other
   bands' keys (a chain of documents that agree further), never all with all. The star is a
   map-side minimum; the chain comes from a range-partitioned sort that cuts through hot keys.
4. Verification. The exact weighted Jaccard similarity of each pair's whole texts; pairs of
   ``SIMILARITY`` or more are links, and classes are the links' connected components.
5. The rest. Documents of a key that are not in the class of its smallest one are held
   against the others of the key by their samples, in blocks of about ``BLOCK`` by ``BLOCK``.
   Pairs that agree in ``AGREE`` samples or more are compared where the blocks meet, by their
   weighted shingles, unless their classes have been joined there already. A task hands on
   only pairs that join two classes, so what leaves it grows with its documents and not with
   its pairs. (At a similarity of 0.8 fewer samples agree once in 5,000 pairs.)

The idf is smoothed to 1 .. 1 + IDF_SHARE: a group of near copies raises the frequency of its
own shingles, and with a plain logarithm a group holding a third of the corpus would count
little more than its members' few differences and fall apart.

Defined results: a null text and one without words have no shingles and are linked only
with rows of the same text; texts of fewer than five words are one shingle; a null id belongs
to no class and is always kept; rows that repeat an id are one document (its first text in
order is kept); an empty table gives an empty result; other columns pass through
``without_near_copies`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import column, place, sealed, unsealed
from waybill.llm.components import components
from waybill.llm.words import factors, mix, shingles
from waybill.session import stored

SHINGLE = 5
SIMILARITY = 0.8
COUNTERS = 1 << 20
CHUNK = 1 << 12  # counters per row of the frequency table
BANDS, ROWS = 10, 3
IDF_SHARE = 0.25
BLOCK, AGREE = 1024, 16

_U = np.uint64
_BLOCK = 2048  # shingles sampled at a time


def document_frequencies(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Counters of (id, text) rows: in how many documents a shingle of each counter occurs.
    The last entry is the number of documents with shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = shingles(text or "", k)
                seen += bool(len(found))
                n[np.unique(found % _U(COUNTERS)).astype(np.int64)] += 1
        rows = n.reshape(-1, CHUNK)
        some = np.flatnonzero(rows.any(axis=1)).tolist()
        sparse = [np.flatnonzero(rows[i]) for i in some]
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array([-1, *some], pa.int32()),
            "at": pa.array([b"", *[s.astype("<u2").tobytes() for s in sparse]], pa.binary()),
            "n": pa.array(
                [np.array([seen], "<i8").tobytes(),
                 *[rows[i][s].astype("<i8").tobytes() for i, s in zip(some, sparse)]],
                pa.binary(),
            ),
        })

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["n"], "<i8")
                if row["chunk"] < 0:
                    total[-1] = total.get(-1, 0) + n
                else:
                    held = total.setdefault(row["chunk"], np.zeros(CHUNK, np.int64))
                    held[np.frombuffer(row["at"], "<u2")] += n
        if total:
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(list(total), pa.int32()),
                "n": pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary()),
            })

    parts = docs.select("text").mapInArrow(count, "chunk int, at binary, n binary")
    # as many rows as counters / CHUNK, whatever the corpus
    summed = parts.repartition("chunk").mapInArrow(add, "chunk int, n binary").collect()
    out = np.zeros(COUNTERS + 1, np.int64)
    for row in summed:
        n = np.frombuffer(row.n, "<i8")
        if row.chunk < 0:
            out[-1] = n[0]
        else:
            out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = n
    return out


def idf_table(frequencies: np.ndarray) -> np.ndarray:
    """Smoothed idf per counter, between 1 and 1 + IDF_SHARE."""
    n = max(1, int(frequencies[-1]))
    rare = np.log(n / np.clip(frequencies[:-1], 1, n))
    return (1 + IDF_SHARE * rare / max(1e-9, np.log(max(2, n)))).astype(np.float32)


def weighted(text: str | None, idf: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights."""
    found, tf = np.unique(shingles(text or "", k), return_counts=True)
    return found, tf.astype(np.float32) * idf[(found % _U(COUNTERS)).astype(np.int64)]


def weighted_jaccard(a, b) -> float:
    (xa, wa), (xb, wb) = a, b
    if not len(xa) or not len(xb):
        return 0.0
    _, ia, ib = np.intersect1d(xa, xb, assume_unique=True, return_indices=True)
    shared = float(np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64))
    total = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - shared
    return shared / total


@lru_cache(1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the middle of 2^16 equal steps of probability, and its logarithm."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):  # its distribution function is 1 - (1 + x) exp(-x)
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return low.astype(np.float32), np.log(low).astype(np.float32)


def samples(found: np.ndarray, weight: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n consistent weighted samples of the shingles, each as one 64-bit value."""
    gamma, log_gamma = _gamma()
    salt = factors(n, salt=77)[:, None]
    best = np.full(n, np.inf, np.float32)
    out = np.zeros(n, _U)
    log_w = np.log(weight)
    for at in range(0, len(found), _BLOCK):
        x = found[at : at + _BLOCK]
        h = mix(x[None, :] * salt)
        r = gamma[(h & _U(0xFFFF)).astype(np.int32)]
        log_c = log_gamma[((h >> _U(16)) & _U(0xFFFF)).astype(np.int32)]
        beta = ((h >> _U(32)) & _U(0xFFFF)).astype(np.float32) * np.float32(1 / (1 << 16))
        t = np.floor(log_w[None, at : at + _BLOCK] / r + beta)
        log_a = log_c - r * (t - beta + 1)
        place = log_a.argmin(axis=1)
        value = log_a[np.arange(n), place]
        step = t[np.arange(n), place].astype(np.int64).astype(_U)
        drawn = mix(x[place] + step * _U(0x9E3779B97F4A7C15))
        better = value < best
        best, out = np.where(better, value, best), np.where(better, drawn, out)
    return out


def band_keys(drawn: np.ndarray) -> np.ndarray:
    by = factors(BANDS * ROWS, salt=5)
    return mix((drawn * by).reshape(BANDS, ROWS).sum(axis=1, dtype=_U)).view(np.int64)


def _sketched(docs: DataFrame, idf) -> DataFrame:
    """(id, text) rows as (id, copy, keys, drawn): a digest of the text, the band keys and
    16 bits of every sample."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(idf.value, np.float32)
        for batch in batches:
            keys, drawn = [], []
            for text in batch.column("text").to_pylist():
                found, weight = weighted(text, table)
                some = samples(found, weight) if len(found) else None
                keys.append([] if some is None else band_keys(some).tolist())
                drawn.append(b"" if some is None else some.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("copy"),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(drawn, pa.binary()),
                ],
                names=["id", "copy", "keys", "drawn"],
            )

    rows = docs.select("id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("copy"))
    return rows.mapInArrow(sketch, "id bigint, copy string, keys array<bigint>, drawn binary")


def key_members(reps: DataFrame) -> DataFrame:
    """One row per document and band whose key others share, with the key's smallest
    document (low) and number of documents (n)."""
    banded = reps.select("rep", "keys", F.posexplode("keys").alias("band", "key")).select(
        "rep",
        "band",
        "key",
        # the keys of the bands after it
        *[F.get("keys", (F.col("band") + i) % BANDS).alias(f"next{i}") for i in (1, 2, 3)],
    )
    group = ["band", "key"]
    shared = banded.groupBy(*[F.col(c).alias(f"__{c}") for c in group]).agg(
        F.min("rep").alias("__low"), F.count(F.lit(1)).alias("__n")
    ).filter("__n > 1")
    match = (F.col("band") == F.col("__band")) & (F.col("key") == F.col("__key"))
    members = banded.join(shared, match).drop("__band", "__key")
    members = members.withColumnRenamed("__low", "low").withColumnRenamed("__n", "n")
    return stored(members, "members")


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs a < b, at most two per document and band."""
    star = members.select(F.col("low").alias("a"), F.col("rep").alias("b"))
    order = ["band", "key", "next1", "next2", "next3", "rep"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            band, key, rep = (batch.column(c).to_numpy(zero_copy_only=False)
                              for c in ("band", "key", "rep"))
            if last is not None:
                band, key, rep = (np.concatenate([[x], y]) for x, y in zip(last, (band, key, rep)))
            same = (band[1:] == band[:-1]) & (key[1:] == key[:-1])
            a, b = rep[:-1][same], rep[1:][same]
            last = band[-1], key[-1], rep[-1]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    sorted_members = members.repartitionByRange(*order).sortWithinPartitions(*order)
    chained = sorted_members.select("band", "key", "rep").mapInArrow(chain, "a bigint, b bigint")
    return star.unionByName(chained).filter("a < b").distinct()


def _shingled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found, times) of the documents: the low 32 bits of their shingles, which name the
    counter too, and how often each occurs, in as few bytes as that takes."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, times = [], []
            for text in batch.column("text").to_pylist():
                low = (shingles(text or "", SHINGLE) & _U(0xFFFFFFFF)).astype("<u4")
                found, n = np.unique(low, return_counts=True)
                wide = next(k for k in ("<u1", "<u2", "<u4") if n.max(initial=0) <= np.iinfo(k).max)
                cut.append(found.tobytes())
                times.append(n.astype(wide).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(cut, pa.binary()), pa.array(times, pa.binary())],
                names=["id", "found", "times"],
            )

    wanted = ids.select(F.col("rep").alias("__rep")).distinct()
    rows = docs.join(wanted, F.col("id") == F.col("__rep")).select("id", "text")
    return rows.mapInArrow(shingle, "id bigint, found binary, times binary")


def _read_shingles(row: dict, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, and their weights."""
    found = np.frombuffer(row["found"], "<u4")
    kind = f"<u{len(row['times']) // max(1, len(found))}" if len(found) else "<u1"
    times = np.frombuffer(row["times"], kind)
    return found, times.astype(np.float32) * idf[found % np.uint32(COUNTERS)]


class _Classes:
    """Classes joined so far."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.root[self.find(a)] = self.find(b)


def joining_pairs(
    asked: list[dict], others: list[dict], band: int, similarity: float, idf: np.ndarray
) -> list[tuple[int, int]]:
    """Pairs (a, b) of two blocks that are similar and join two classes."""
    parts = lambda rows: (
        *(np.array([r[c] for r in rows]) for c in ("rep", "class", "apart", "keys")),
        np.frombuffer(b"".join(r["drawn"] for r in rows), "<u2").reshape(len(rows), -1),
        *zip(*[_read_shingles(r, idf) for r in rows]),
    )
    (x, xc, _, xk, xs, xf, xw), (y, yc, ya, yk, ys, yf, yw) = parts(asked), parts(others)
    agree = np.zeros((len(x), len(y)), np.int8)
    for i in range(BANDS * ROWS):
        agree += xs[:, i, None] == ys[None, :, i]
    fine = (agree >= AGREE) & (xc[:, None] != yc[None, :])
    # of two that both ask the smaller one does
    fine &= ~ya[None, :] | (x[:, None] < y[None, :])
    # those that share an earlier band's key meet there
    for earlier in range(band):
        fine &= xk[:, earlier, None] != yk[None, :, earlier]
    # the smaller total is at least that share of the larger; a little less, for rounding
    wx, wy = (np.array([w.sum(dtype=np.float64) for w in ws]) for ws in (xw, yw))
    low = similarity - 1e-4
    fine &= np.minimum(wx[:, None], wy[None, :]) >= low * np.maximum(wx[:, None], wy[None, :])
    i, j = np.nonzero(fine)
    order = np.argsort(-agree[i, j], kind="stable")
    classes, out = _Classes(), []
    for i, j in zip(i[order].tolist(), j[order].tolist()):
        a, b = int(xc[i]), int(yc[j])
        if classes.find(a) == classes.find(b):
            continue
        at = np.searchsorted(yf[j], xf[i])
        at[at == len(yf[j])] = 0
        same = yf[j][at] == xf[i]
        shared = float(np.minimum(xw[i][same], yw[j][at[same]]).sum(dtype=np.float64))
        if shared >= low * (wx[i] + wy[j] - shared):
            classes.join(a, b)
            out.append((int(min(x[i], y[j])), int(max(x[i], y[j]))))
    return out


def remaining_pairs(
    members: DataFrame, reps: DataFrame, classes: DataFrame, docs: DataFrame, idf,
    similarity: float,
) -> DataFrame:
    """Pairs (a, b) of documents that share a key but, so far, no class, and are similar:
    of every two blocks of a key those that join two classes."""
    of = classes.select(F.col("node").alias("__node"), F.col("component").alias("__of"))
    low = of.select(F.col("__node").alias("__low"), F.col("__of").alias("__low_of"))
    named = (
        members.select("rep", "band", "key", "low", "n")
        .join(of, F.col("rep") == F.col("__node"), "left")
        .join(low, F.col("low") == F.col("__low"), "left")
        .select("rep", "band", "key", "n", F.coalesce("__of", "rep").alias("class"),
                F.coalesce("__low_of", "low").alias("main"))
        .select("rep", "band", "key", "n", "class", (F.col("class") != F.col("main")).alias("apart"))
    )
    keys = named.filter("apart").select("band", "key").distinct()
    around = stored(named.join(keys, ["band", "key"], "left_semi"), "around")
    drawn = reps.select(F.col("rep").alias("__rep"), "keys", "drawn")
    weights = stored(_shingled(docs, around), "shingles").withColumnRenamed("id", "__id")
    whole = around.join(drawn, F.col("rep") == F.col("__rep")).join(
        weights, F.col("rep") == F.col("__id"))
    parts = F.ceil(F.col("n") / BLOCK)
    row = F.struct("rep", "class", "apart", "keys", "drawn", "found", "times")
    blocked = whole.withColumns({"parts": parts, "block": F.pmod(F.xxhash64("rep"), parts)})

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        # by the columns of the join below: the blocks are not dealt out twice
        return rows.groupBy("band", "key", "block").agg(
            F.max("parts").alias("parts"), F.collect_list(row).alias(name))

    # every asked block is sent to each block of its key, so no key meets in one task
    asked = blocks(blocked.filter("apart"), "asked").select(
        "band", "key", "asked", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"))
    others = blocks(blocked, "others").select(
        F.col("band").alias("__band"), F.col("key").alias("__key"), "block", "others")

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(idf.value, np.float32)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                found = joining_pairs(r["asked"], r["others"], r["band"], similarity, table)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([p[0] for p in found], pa.int64()),
                    "b": pa.array([p[1] for p in found], pa.int64()),
                })

    match = (F.col("band") == F.col("__band")) & (F.col("key") == F.col("__key")) & (
        F.col("to") == F.col("block"))
    both = asked.join(others, match).select("band", "asked", "others")
    return both.mapInArrow(closest, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, docs: DataFrame, idf, similarity: float) -> DataFrame:
    """Pairs (a, b, similarity) whose whole texts are at least that similar."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("__id")).distinct()
    ids = stored(ids, "compared")
    # one text per id: rows that repeat an id were one document from the start
    texts = docs.join(ids, F.col("id") == F.col("__id")).select("id", "text")
    texts = stored(texts, "texts")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(idf.value, np.float32)
        held: dict = {}

        def vector(key, text):
            if key not in held:
                if len(held) > 64:
                    held.clear()
                held[key] = weighted(text, table)
            return held[key]

        for batch in batches:
            out = [
                weighted_jaccard(vector(r["a"], r["text_a"]), vector(r["b"], r["text_b"]))
                for r in batch.to_pylist()
            ]
            found = pa.array(out, pa.float64())
            whole = pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), found], names=["a", "b", "similarity"]
            )
            yield whole.filter(pa.array([s >= similarity for s in out], pa.bool_()))

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(compare, "a bigint, b bigint, similarity double")


def near_copies(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """(key, class_id, kept) per row: the smallest key of its class, and whether it is that."""
    spark = docs.sparkSession
    rows = docs.select(column(key).cast("bigint").alias("id"), column(text).alias("text"))
    named = rows.filter("id IS NOT NULL")
    idf = spark.sparkContext.broadcast(idf_table(document_frequencies(named)).tobytes())
    drawn = stored(_sketched(named, idf), "sketches")
    # one row per distinct text
    reps = stored(
        drawn.groupBy("copy").agg(
            F.min("id").alias("rep"),
            F.min_by("keys", "id").alias("keys"),
            F.min_by("drawn", "id").alias("drawn"),
        ),
        "reps",
    )
    members = key_members(reps.filter(F.size("keys") > 0))
    # compare each distinct text once, by its smallest id
    firsts = named.groupBy("id").agg(F.min("text").alias("text")) if _repeats(drawn) else named

    def linked(pairs: DataFrame) -> DataFrame:
        found = verified(pairs, firsts, idf, similarity)
        return stored(found.select("a", "b"), "verified")

    links = linked(stored(candidate_pairs(members), "candidates"))
    if firsts is not named:  # an id's texts belong together
        same = drawn.select("id", "copy").join(reps.select("copy", "rep"), "copy")
        links = links.unionByName(same.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    classes = components(links)
    more = linked(stored(remaining_pairs(members, reps, classes, firsts, idf, similarity), "pairs"))
    if not more.isEmpty():
        joined = classes.select(F.col("node").alias("a"), F.col("component").alias("b"))
        classes = components(joined.unionByName(more))
    by_copy = reps.select(F.col("copy").alias("__copy"), "rep").join(
        classes, F.col("rep") == F.col("node"), "left"
    ).select("__copy", F.coalesce("component", "rep").alias("class_id"))
    found = drawn.select("id", "copy").join(by_copy, F.col("copy") == F.col("__copy"))
    kept = F.col("id") == F.col("class_id")
    out = found.select(F.col("id").alias(key), "class_id", kept.alias("kept"))
    null = rows.filter("id IS NULL").select(
        F.col("id").alias(key),
        F.lit(None).cast("bigint").alias("class_id"),
        F.lit(True).alias("kept"),
    )
    return out.unionByName(null)


def _repeats(drawn: DataFrame) -> bool:
    """Whether any id has more than one row."""
    return not drawn.groupBy("id").count().filter("count > 1").isEmpty()


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest key of their class, columns unchanged."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    classes = stored(near_copies(docs, **options), "classes")
    gone = stored(
        classes.filter("NOT kept").select(F.col(key).alias("__gone")).distinct(), "dropped"
    )
    match = F.col(place(docs, key)) == F.col("__gone")
    rest = sealed(docs).join(gone, match, "left_anti")
    repeated = (
        classes.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__gone")).count().filter("count > 1").drop("count")
    )
    repeated = stored(repeated, "repeated")
    if repeated.isEmpty():
        return rest.select(*unsealed(docs))
    once = Window.partitionBy(place(docs, key)).orderBy(F.asc_nulls_first(place(docs, text)))
    again = rest.join(repeated, match, "left_semi").withColumn("__place", F.row_number().over(once))
    first = again.filter("__place = 1").drop("__place")
    return rest.join(repeated, match, "left_anti").unionByName(first).select(*unsealed(docs))
