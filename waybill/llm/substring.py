"""Removing passages that a document with a smaller key has too.

A window is ``WINDOW`` consecutive words. Every word of a window whose word sequence also
starts in a document with a smaller key is removed; windows are judged on the input.

1. Anchors. Of the runs of ``GRAM`` words in a window the one with the smallest hash is its
   anchor, so equal windows have equal anchors, and neighbouring windows mostly share one.
   Anchors that occur in one document only are dropped: each task sorts and packs its own
   anchors per bucket, and a bucket compares them. Equal texts are found first by digest;
   of such a group the smallest key stands for all.
2. Segments. Around each shared anchor a document's windows form a segment of at most
   ``2 * WINDOW - GRAM`` words. Segments are dealt out by anchor: an anchor's segments, in
   ascending key order, are one shard. They stream through the suffix automaton of those
   before them; where the matching statistic reaches ``WINDOW`` words, a window is found,
   and maximal runs of such windows are removed. Then the segment is added to the automaton.
3. Hot anchors. A shard holds at most ``HOT`` documents, which bounds its automaton. Segments
   of more frequent anchors (a line that a third of all documents share) are first reduced,
   on the map side, to the distinct ones and their smallest keys; the windows of those take
   grouped minima, and the documents' segments look theirs up.

The automata travel to the data, not the reverse: here the reference is the corpus itself,
so automata of all of it, broadcast, would grow with the corpus, and every document would
meet every shard. Words are compared by 64-bit hashes, of which a segment keeps 48 bits
beside its anchor.

Defined results: a null text has no words; a null key has no order, so such rows lose
nothing and nothing is removed for them; rows that repeat a key are judged one by one
against smaller keys only; an empty table gives an empty result; other columns are not
carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import column
from waybill.llm.words import runs, word_hashes
from waybill.session import stored

WINDOW = 13
GRAM = 4
HOT = 2000
BUCKET_DOCS = 4000  # documents per bucket of anchors, on average

_U = np.uint64
_CUT = 6  # bytes of a word's hash that a segment carries


def anchored(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the anchor's hash and place in the text."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    grams = runs(hashes, GRAM)
    width = window - GRAM + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):  # the last of equal ones
        other = grams[j : j + n]
        better = other <= best
        best = np.where(better, other, best)
        at[better] = j
    return best, at + np.arange(n)


def _anchor_rows(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """Each batch's distinct (anchor, document) pairs, packed per bucket."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, ids = [], []
            for key, text, copy in zip(*(batch.column(c).to_pylist()
                                         for c in ("id", "text", "copy"))):
                if key is None or copy or not text:
                    continue
                found = np.unique(anchored(word_hashes(text.encode()), window)[0])
                anchors.append(found)
                ids.append(np.full(len(found), key, np.int64))
            if not anchors:
                continue
            a, d = np.concatenate(anchors), np.concatenate(ids)
            bucket = (a % _U(buckets)).astype(np.int64)
            order = np.lexsort((a, bucket))
            a, d, bucket = a[order], d[order], bucket[order]
            names, starts = np.unique(bucket, return_index=True)
            ends = np.append(starts[1:], len(a))
            low = int(d.min()) if len(d) else 0
            kind = "<u4" if len(d) and int(d.max()) - low < 1 << 32 else "<i8"
            off = (d - low).astype(kind)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(names, pa.int64()),
                "low": pa.array([low] * len(names), pa.int64()),
                "anchors": pa.array([a[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                "ids": pa.array([off[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
            })

    return docs.mapInArrow(collect, "bucket bigint, low bigint, anchors binary, ids binary")


def shared_anchors(docs: DataFrame, buckets: int, window: int, hot: int) -> DataFrame:
    """(key, light, heavy) per document: its anchors that other documents have too."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, ids, of = [], [], None

        def shared():
            a, d = np.concatenate(anchors), np.concatenate(ids)
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            # rows that repeat a key count once
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            a, d = a[fresh], d[fresh]
            begins = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            n = np.diff(begins, append=len(a))
            n = np.repeat(n, n)
            some = n > 1
            for at in range(0, int(some.sum()), 100_000):
                part = np.flatnonzero(some)[at : at + 100_000]
                yield pa.RecordBatch.from_pydict({
                    "id": d[part], "anchor": a[part].view(np.int64), "heavy": n[part] > hot,
                })

        for batch in batches:
            for row in batch.to_pylist():
                if of is not None and row["bucket"] != of:
                    yield from shared()
                    anchors, ids = [], []
                of = row["bucket"]
                a = np.frombuffer(row["anchors"], "<u8")
                wide = len(row["ids"]) == 8 * len(a)
                anchors.append(a)
                ids.append(np.frombuffer(row["ids"], "<i8" if wide else "<u4").astype(np.int64)
                           + row["low"])
        if of is not None:
            yield from shared()

    packed = _anchor_rows(docs, buckets, window)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(compare, "id bigint, anchor bigint, heavy boolean")
    return found.groupBy(F.col("id").alias("__id")).agg(
        F.collect_list(F.when(~F.col("heavy"), F.col("anchor"))).alias("light"),
        F.collect_list(F.when(F.col("heavy"), F.col("anchor"))).alias("heavy"),
    )


class SuffixAutomaton:
    """All runs of the words added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        """One more sequence; runs do not reach from one sequence into another."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for w in words:
            p, q = last, nxt[last].get(w)
            if q is not None and length[q] == length[p] + 1:
                last = q
                continue
            cur = -1
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                last = cur
                if p < 0:
                    continue
                q = nxt[p][w]
            if length[q] == length[p] + 1:
                link[cur] = q
                continue
            clone = len(nxt)
            nxt.append(nxt[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = clone
            if cur < 0:
                last = clone
            else:
                link[cur] = clone

    def matches(self, words: list[int]) -> list[int]:
        """Matching statistics: how many words up to each place were seen in a row."""
        nxt, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            out.append(n)
        return out


class Shard:
    """Segments of one anchor in ascending key order."""

    def __init__(self, window: int):
        self.window = window
        self.known: set[bytes] = set()  # whole segments of smaller keys
        self.automaton: SuffixAutomaton | None = None
        self.queue: list[bytes] = []  # segments of smaller keys not yet in the automaton

    def windows(self, raw: bytes) -> list[tuple[int, int]]:
        """(start, count) of runs of windows that an added segment has."""
        n = len(raw) // _CUT - self.window + 1
        if raw in self.known:
            return [(0, n)]
        if not self.known:
            return []
        if self.automaton is None:
            self.automaton = SuffixAutomaton()
        for other in self.queue:
            self.automaton.add(_words(other))
        self.queue = []
        out: list[tuple[int, int]] = []
        for end, matched in enumerate(self.automaton.matches(_words(raw))):
            if matched >= self.window:
                at = end - self.window + 1
                if out and sum(out[-1]) == at:
                    out[-1] = (out[-1][0], out[-1][1] + 1)
                else:
                    out.append((at, 1))
        return out

    def add(self, raw: bytes) -> None:
        if raw not in self.known:
            self.known.add(raw)
            self.queue.append(raw)


def _words(raw: bytes) -> list[int]:
    wide = np.zeros((len(raw) // _CUT, 8), np.uint8)
    wide[:, :_CUT] = np.frombuffer(raw, np.uint8).reshape(-1, _CUT)
    return wide.reshape(-1).view("<u8").tolist()


def _segments(docs: DataFrame, which: str, window: int) -> DataFrame:
    """Segments around the document's anchors in column ``which``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("anchor", "id", "text_hash", "start", "words")}
            names = ("id", "text", "copy", "text_hash", which)
            for key, text, copy, text_hash, shared in zip(
                *(batch.column(c).to_pylist() for c in names)
            ):
                if key is None or copy or not text or not shared:
                    continue
                hashes = word_hashes(text.encode())
                anchors, place = anchored(hashes, window)
                if not len(anchors):
                    continue
                begins = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                ends = np.append(begins[1:], len(place))
                some = np.isin(anchors[begins], np.array(shared, np.int64).view(_U))
                raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_CUT].tobytes()
                for s, e in zip(begins[some].tolist(), ends[some].tolist()):
                    out["start"].append(s)
                    out["words"].append(raw[s * _CUT : (e + window - 1) * _CUT])
                kept = anchors[begins[some]].view(np.int64).tolist()
                out["anchor"] += kept
                out["id"] += [key] * len(kept)
                out["text_hash"] += [text_hash] * len(kept)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(out["anchor"], pa.int64()),
                "id": pa.array(out["id"], pa.int64()),
                "text_hash": pa.array(out["text_hash"], pa.int64()),
                "start": pa.array(out["start"], pa.int32()),
                "words": pa.array(out["words"], pa.binary()),
            })

    return docs.mapInArrow(
        cut, "anchor bigint, id bigint, text_hash bigint, start int, words binary"
    )


SPANS = "id bigint, text_hash bigint, start int, n int"


def _matched(segments: DataFrame, window: int) -> DataFrame:
    """Runs of windows (id, text_hash, start, n) that a smaller key has too."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, key, shard, own = None, None, None, []
        for batch in batches:
            out: list[tuple] = []
            for a, d, h, start, raw in zip(*(batch.column(c).to_pylist() for c in (
                    "anchor", "id", "text_hash", "start", "words"))):
                if a != anchor:
                    anchor, key, shard, own = a, d, Shard(window), []
                elif d != key:  # a document's own segments count for larger keys only
                    for other in own:
                        shard.add(other)
                    key, own = d, []
                own.append(raw)
                out += [(d, h, start + s, n) for s, n in shard.windows(raw)]
            ids, hashes, starts, ns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()),
                "text_hash": pa.array(hashes, pa.int64()),
                "start": pa.array(starts, pa.int32()),
                "n": pa.array(ns, pa.int32()),
            })

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor", "id", "start")
    return dealt.mapInArrow(stream, SPANS)


def _hot_matched(segments: DataFrame, window: int) -> DataFrame:
    """(id, spans) per segment: its windows that a smaller key has too."""
    named = segments.withColumn("segment", F.md5("words"))
    distinct = named.groupBy("segment").agg(F.min("id").alias("low"), F.min("words").alias("words"))
    n = (F.octet_length("words") / _CUT).cast("int") - window + 1
    windows = distinct.select(
        "segment", "low", "words", F.explode(F.sequence(F.lit(0), n - 1)).alias("at")
    ).select(
        "segment",
        "low",
        "at",
        F.md5(F.substring("words", F.col("at") * _CUT + 1, F.lit(window * _CUT))).alias("window"),
    )
    lowest = windows.groupBy(F.col("window").alias("__window")).agg(F.min("low").alias("__low"))
    found = windows.join(lowest, F.col("window") == F.col("__window"))
    found = found.groupBy(F.col("segment").alias("__segment")).agg(
        F.collect_list(F.struct("at", "__low")).alias("found")
    )
    met = named.join(found, F.col("segment") == F.col("__segment"))
    span = lambda x: F.struct(
        "text_hash", (F.col("start") + x["at"]).alias("start"), F.lit(1).alias("n")
    )
    spans = F.transform(F.filter("found", lambda x: x["__low"] < F.col("id")), span)
    return met.select("id", spans.alias("spans")).filter(F.size("spans") > 0)


def without_repeats(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    hot: int = HOT,
) -> DataFrame:
    """(key, n_words, n_removed, kept): the kept words of every row, joined by one space."""
    rows = docs.select(
        column(key).cast("bigint").alias("id"), column(text).cast("string").alias("text")
    )
    # equal texts: all but the smallest key hold nothing new
    named = rows.select("id", F.sha2("text", 256).alias("digest")).filter("digest IS NOT NULL")
    first = named.groupBy(F.col("digest").alias("__digest")).agg(
        F.min("id").alias("__first"), F.count(F.lit(1)).alias("__rows")
    ).filter("__rows > 1")
    copies = named.join(first, F.col("digest") == F.col("__digest")).filter("__first < id")
    copies = copies.groupBy(F.col("id").alias("__of")).agg(F.collect_set("digest").alias("__copies"))
    # by the key alone and always as a shuffle, like the joins below: the texts are dealt
    # out once, and that exchange serves all three uses
    copies = stored(copies, "copies").hint("merge")
    same = F.array_contains("__copies", F.sha2("text", 256))
    base = rows.join(copies, F.col("id") == F.col("__of"), "left").select(
        "id", "text", F.xxhash64("text").alias("text_hash"),
        F.coalesce(same, F.lit(False)).alias("copy"),
    )
    buckets = max(64, docs.count() // BUCKET_DOCS)
    anchors = shared_anchors(base.select("id", "text", "copy"), buckets, window, hot)
    with_anchors = base.join(anchors, F.col("id") == F.col("__id"), "left").drop("__id")
    light = _matched(_segments(with_anchors, "light", window), window)
    light = light.select("id", F.array(F.struct("text_hash", "start", "n")).alias("spans"))
    heavy = _hot_matched(_segments(with_anchors, "heavy", window), window)
    spans = light.unionByName(heavy).groupBy(F.col("id").alias("__id")).agg(
        F.flatten(F.collect_list("spans")).alias("spans")
    )
    final = base.join(spans, F.col("id") == F.col("__id"), "left").drop("__id")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, text_hash, copy, spans in zip(*(batch.column(c).to_pylist() for c in (
                    "text", "text_hash", "copy", "spans"))):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                if copy and len(words) >= window:
                    gone[0], gone[-1] = 1, -1
                for s in spans or ():
                    if s["text_hash"] == text_hash:
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n"] + window - 1] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stay.sum()))
                left = words if stay.all() else [w for w, s in zip(words, stay.tolist()) if s]
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    cleaned = final.mapInArrow(remove, "id bigint, n_words bigint, n_removed bigint, kept string")
    return cleaned.withColumnRenamed("id", key)
