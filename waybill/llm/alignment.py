"""Aligning the tokens of two tokenizers by the bytes they cover.

A text's tokens are intervals of its bytes. As a sparse matrix (``Csr``: row starts and column
numbers) a tokenization has one row per token and a one for every byte the token covers.

1. Overlap links. The row product of A with B transposed (Gustavson: for every byte of a row of
   A, the tokens of that byte's row of B transposed) holds, for every pair of tokens that
   overlap, in how many bytes they do.
2. Groups. Bytes at which a token of A and one of B both end cut the text into groups. The
   product of the two token-by-group matrices holds the pairs of tokens in one group.
3. Both tokenizers cut before a single space between two visible characters, so a text is a row
   of pieces that never share a token, and the matrices are block-diagonal. Each worker aligns a
   piece once (``MEMO`` pieces are remembered) and puts texts together from pieces. Whether the
   second vocabulary allows that is read from it; otherwise a text is one piece. A text in which
   some piece does not give its bytes back is one piece, too.
4. Counts. In how many documents an id pair is linked is counted over all of them. Every block
   of documents hands on its distinct id pairs with the number of its documents; Spark adds them
   up, finds each A id's highest count, and gives every block the counts of its own pairs back.
   No document meets all pairs, and nothing is broadcast.

Defined results: null and empty texts, and texts whose tokens do not give the bytes back, have
no tokens: counts 0 and an empty string of groups; null keys and rows that repeat a key are
documents of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import column
from waybill.session import stored

MEMO = 200_000  # pieces remembered per worker before it starts afresh
CHARS = 2_000_000  # characters of a block of documents; a longer text is a block of its own

# a space between two visible characters; Python's \s holds all of Unicode's white space
_CUT = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix of ones: row i has the columns ``cols[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    cols: np.ndarray
    width: int

    @staticmethod
    def of_intervals(lengths: np.ndarray) -> Csr:
        """Tokens by bytes: each row covers the bytes after those of the row before."""
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return Csr(starts, np.arange(starts[-1]), int(starts[-1]))

    @staticmethod
    def of_labels(labels: np.ndarray, width: int) -> Csr:
        """One column in each row."""
        return Csr(np.arange(len(labels) + 1), np.asarray(labels, np.int64), width)

    @property
    def rows(self) -> np.ndarray:
        """Row number of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.cols, kind="stable")
        counts = np.bincount(self.cols, minlength=self.width)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return Csr(starts, self.rows[order], len(self.starts) - 1)


def row_products(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the entries of a times b, by row and column.

    Gustavson's way: every entry (i, k) of a adds row k of b to row i of the result. All rows
    are done side by side; the sums are taken over sorted places.
    """
    width = np.diff(b.starts)[a.cols]
    rows = np.repeat(a.rows, width)
    ends = np.cumsum(width)
    within = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - width, width)
    cols = b.cols[np.repeat(b.starts[a.cols], width) + within]
    place, value = np.unique(rows * max(1, b.width) + cols, return_counts=True)
    return place // max(1, b.width), place % max(1, b.width), value


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, shared bytes) of overlapping tokens, from their byte lengths."""
    return row_products(Csr.of_intervals(a), Csr.of_intervals(b).transposed())


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each token of A and of B. Tokens without bytes belong to the group that
    begins where they stand, or to the last one."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    cuts = np.intersect1d(ends_a, ends_b)
    last = max(0, len(cuts) - 1)
    return (np.minimum(np.searchsorted(cuts, ends_a - a, side="right"), last),
            np.minimum(np.searchsorted(cuts, ends_b - b, side="right"), last))


def group_links(of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of all pairs within a group."""
    n = int(max(of_a.max(initial=-1), of_b.max(initial=-1))) + 1
    found = row_products(Csr.of_labels(of_a, n), Csr.of_labels(of_b, n).transposed())
    return found[0], found[1]


class Vocabulary:
    """Bytes of the ids of both tokenizers, and the ids as text with what may follow them."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        self.a_len = np.fromiter(map(len, a), np.int64, len(a))
        self.b_len = np.fromiter(map(len, b), np.int64, len(b))
        self.shift = max(len(a), len(b))
        names = [str(i) for i in range(self.shift)]
        # more ids of the group, its other side, another group, the end of the piece
        self.written = [n + mark for mark in ",|;\n" for n in names]

    def spelled(self, a_ids, b_ids, of_a, of_b, piece_ends: np.ndarray) -> list[str]:
        """Groups as text, a piece each: ids joined by commas, A from B by a bar, groups by
        semicolons. Groups are numbered through; piece_ends: the last group of each piece."""
        more_a, more_b = (np.append(of[1:] == of[:-1], False) for of in (of_a, of_b))
        ends = np.zeros(int(of_b[-1]) + 1 if len(of_b) else 0, bool)
        ends[piece_ends] = True
        marks = np.concatenate([np.where(more_a, 0, 1), np.where(more_b, 0, np.where(ends[of_b], 3, 2))])
        order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
        codes = (np.concatenate([a_ids, b_ids]) + marks * self.shift)[order]
        written = self.written
        return "".join([written[c] for c in codes.tolist()]).split("\n")[:-1]


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: visible ones for
    themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pieces:
    """What pieces of text contribute, side by side: numbers, groups as text, linked id pairs."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.ends = self.keys = self.times = np.zeros(0, np.int64)
        self.fine = np.zeros(0, bool)  # whether the tokens gave the bytes back
        self.spelled: list[str] = []

    def __len__(self) -> int:
        return len(self.spelled)

    def add(self, texts: list[str], a_ids: list[list[int]], b_ids: list[list[int]],
            words: Vocabulary) -> None:
        """Align texts with their tokens: one block-diagonal product for all of them."""
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sides = []
        for ids, lengths in ((a_ids, words.a_len), (b_ids, words.b_len)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            of = np.repeat(np.arange(len(ids)), n)
            sides.append((n, flat, of, lengths[flat]))
        # the bytes are those of the text where their number is and all of them agree
        fine = size > 0
        for _, _, of, lengths in sides:
            fine &= np.bincount(of, lengths, minlength=len(raw)) == size
        some = np.flatnonzero(fine)
        whole = np.frombuffer(b"".join([raw[k] for k in some.tolist()]), np.uint8)
        place = np.repeat(some, size[some])
        for (_, flat, of, _), table in zip(sides, (words.a, words.b)):
            own = np.frombuffer(b"".join([table[i] for i in flat[fine[of]].tolist()]), np.uint8)
            fine[place[own != whole]] = False
        (n_a, flat_a, a_len), (n_b, flat_b, b_len) = (
            (np.where(fine, n, 0), flat[fine[of]], lengths[fine[of]]) for n, flat, of, lengths in sides)
        i, j, _ = overlaps(a_len, b_len)
        of = np.repeat(np.arange(len(texts)), n_a)[i]
        keys = (flat_a[i] << 32) | flat_b[j]
        order = np.lexsort((keys, of))
        of, keys = of[order], keys[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        of_a, of_b = groups(a_len, b_len)
        some = np.flatnonzero(fine)
        last = of_a[np.cumsum(n_a[some]) - 1]
        n_groups = np.zeros(len(texts), np.int64)
        n_groups[some] = np.diff(last, prepend=-1)
        written = iter(words.spelled(flat_a, flat_b, of_a, of_b, last))
        self.spelled += [next(written) if ok else "" for ok in fine.tolist()]
        held = int(self.ends[-1]) if len(self.ends) else 0
        ends = held + np.cumsum(np.bincount(of[first], minlength=len(texts)))
        for name, found in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("ends", ends),
                            ("keys", keys[first]), ("times", np.diff(first, append=len(of))),
                            ("fine", fine)):
            setattr(self, name, np.concatenate([getattr(self, name), found]))


class Aligner:
    """Both tokenizers and the pieces aligned so far."""

    def __init__(self, a_path: str, b_path: str, memo: int = MEMO):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        special = set(self.a.get_added_tokens_decoder())
        vocab = self.a.get_vocab()
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            a_bytes[i] = entry.encode() if i in special else bytes(alphabet[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i)
                   else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.words = Vocabulary(a_bytes, b_bytes)
        shape = json.loads(self.a.to_str())["pre_tokenizer"]
        # no token of B may hold a space that follows something else, nor its normalizer join any
        self.cuttable = (
            self.a.normalizer is None
            and isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel)
            and shape.get("use_regex", True) and not shape.get("add_prefix_space", True)
            and not any("\u2581" in p.lstrip("\u2581") for p in pieces)
            and self.b.encode("a  b") != self.b.encode("a b")
        )
        self.limit = memo
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pieces = Pieces()

    def _learn(self, texts: list[str]) -> None:
        """Align texts, each with a space before it."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts],
                                                      add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        self.pieces.add([" " + t for t in texts], a, b, self.words)

    def tokens(self, text: str | None) -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        """Ids of both and their numbers of bytes; empty where the bytes are not given back."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = self.b.encode(text) if text else []
        own, other = [self.words.a[i] for i in a], [self.words.b[i] for i in b]
        if not text or not b"".join(own) == b"".join(other) == (" " + text).encode():
            a, b, own, other = [], [], [], []
        return a, b, np.array([*map(len, own)], np.int64), np.array([*map(len, other)], np.int64)

    def places(self, texts: list[str]) -> list[list[int]]:
        """For each text the places of its pieces in ``pieces``."""
        if len(self.pieces) > self.limit:
            self._clear()
        parts = [(_CUT.split(t) if self.cuttable else [t]) if t else [] for t in texts]
        known = self.known
        new = list({p for part in parts for p in part if p not in known})
        if new:
            at = len(self.pieces)
            self._learn(new)
            known.update(zip(new, range(at, at + len(new))))
        out = [[known[p] for p in part] for part in parts]
        fine = self.pieces.fine
        # bytes were lost in some piece: the text as a whole
        lost = [k for k, at in enumerate(out) if at and not fine[at].all()]
        if lost:
            at = len(self.pieces)
            self._learn([texts[k] for k in lost])
            for i, k in enumerate(lost):
                out[k] = [at + i] if self.pieces.fine[at + i] else []
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per Python worker and pair of files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_DOCS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
# a row per block of documents: their columns, the block's distinct id pairs with their numbers
# of documents, and each document's pairs, as places among those, with their numbers of links
_PAIR = "array<struct<a:int,b:int,docs:bigint>>"
BLOCK = (", ".join(f"{c} array<bigint>" for c in _DOCS)
         + f", digest array<string>, pairs {_PAIR}, ends array<bigint>, places binary, times binary")


def _block(both: Aligner, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    places = both.places(texts)
    pieces = both.pieces
    digests = [hashlib.sha256(";".join([pieces.spelled[p] for p in at]).encode()).hexdigest()
               if at else "" for at in places]
    n = len(texts)
    at = np.array([p for part in places for p in part], np.int64)
    doc = np.repeat(np.arange(n), [len(part) for part in places])
    total = lambda x: np.bincount(doc, x[at], minlength=n).astype(np.int64)
    # every piece's pairs, once for each place it stands at
    starts = np.concatenate([[0], pieces.ends[:-1]]).astype(np.int64)
    width = (pieces.ends - starts)[at]
    ends = np.cumsum(width)
    entry = np.repeat(starts[at] - (ends - width), width) + np.arange(int(width.sum()))
    distinct, code = np.unique(pieces.keys[entry], return_inverse=True)
    held, where = np.unique(np.repeat(doc, width) * max(1, len(distinct)) + code, return_inverse=True)
    times = np.bincount(where, pieces.times[entry]).astype(np.int64)
    owner, code = held // max(1, len(distinct)), held % max(1, len(distinct))
    n_docs = np.bincount(code, minlength=len(distinct))
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    pairs = pa.StructArray.from_arrays(
        [pa.array(distinct >> 32, pa.int32()), pa.array(distinct & 0xFFFFFFFF, pa.int32()),
         pa.array(n_docs, pa.int64())], names=["a", "b", "docs"])
    columns = {
        "doc_id": pa.ListArray.from_arrays([0, n], ids),
        "n_a": one(total(pieces.n_a), pa.int64()),
        "n_b": one(total(pieces.n_b), pa.int64()),
        "n_groups": one(total(pieces.n_groups), pa.int64()),
        "n_links": one(np.bincount(owner, times, minlength=n).astype(np.int64), pa.int64()),
        "digest": one(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays([0, len(distinct)], pairs),
        "ends": one(np.searchsorted(owner, np.arange(n), side="right"), pa.int64()),
        "places": pa.array([code.astype("<u4").tobytes()], pa.binary()),
        "times": pa.array([times.astype("<u4").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of documents, of about ``CHARS`` characters each."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = size = 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= CHARS or k == len(texts) - 1:
                    ids = batch.column("id").slice(at, k + 1 - at)
                    yield _block(both, ids, texts[at : k + 1])
                    at, size = k + 1, 0

    return docs.mapInArrow(align, BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that hold an id pair linked, and whether no other pair of
    its A id has more."""
    single = blocks.select(F.explode("pairs").alias("p")).select("p.*")
    counts = stored(single.groupBy("a", "b").agg(F.sum("docs").alias("count")), "pair-counts")
    top = counts.groupBy(F.col("a").alias("__a")).agg(F.max("count").alias("__most"))
    return counts.join(top, F.col("a") == F.col("__a")).select(
        "a", "b", "count", (F.col("count") == F.col("__most")).alias("best")
    )


def aligned(
    docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    rows = docs.select(column(key).cast("bigint").alias("id"), column(text).alias("text"))
    blocks = _aligned(rows, a_path, b_path).withColumn("block", F.monotonically_increasing_id())
    blocks = stored(blocks, "aligned")
    counts = pair_counts(blocks).select(
        F.col("a").alias("__a"), F.col("b").alias("__b"), "count", "best"
    )
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "p"))
    answers = (
        asked.select("block", "at", "p.a", "p.b")
        .join(counts, (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")))
        .groupBy(F.col("block").alias("__block"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("answers"))
    )
    whole = blocks.drop("pairs").join(answers, F.col("block") == F.col("__block"), "left").select(
        *_DOCS, "digest", "ends", "places", "times",
        F.col("answers.count").alias("counts"), F.col("answers.best").alias("bests"),
    )

    def finish(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in found:
            for i in range(part.num_rows):
                r = part.slice(i, 1).to_pylist()[0]
                places = np.frombuffer(r["places"], "<u4")
                times = np.frombuffer(r["times"], "<u4").astype(np.int64)
                counts = np.array(r["counts"] or [], np.int64)[places]
                best = np.array(r["bests"] or [], bool)[places]
                edges = np.concatenate([[0], r["ends"]]).astype(np.int64)
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array(r[c], pa.int64()) for c in _DOCS},
                    "n_best": pa.array(total(times * best), pa.int64()),
                    "count_sum": pa.array(total(times * counts), pa.int64()),
                    "groups_sha256": pa.array(r["digest"], pa.string()),
                })

    names = [*_DOCS, "n_best", "count_sum"]
    out = whole.mapInArrow(finish, ", ".join(f"{c} bigint" for c in names) + ", groups_sha256 string")
    return out.withColumnRenamed("doc_id", key)


def token_links(
    docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: the ids of both tokenizations, the pairs of overlapping tokens with their
    shared bytes, and the pairs of tokens in one group; tokens by their places from 0."""
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    shared = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])
    schema = pa.schema([
        ("id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
        ("overlaps", pa.list_(shared)), ("in_group", pa.list_(pair)),
    ])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        for batch in batches:
            for k, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                a_ids, b_ids, a_len, b_len = both.tokens(t)
                i, j, n = overlaps(a_len, b_len)
                g, h = group_links(*groups(a_len, b_len))
                row = {
                    "id": k, "a_ids": a_ids, "b_ids": b_ids,
                    "overlaps": [{"a": x, "b": y, "bytes": z}
                                 for x, y, z in zip(i.tolist(), j.tolist(), n.tolist())],
                    "in_group": [{"a": x, "b": y} for x, y in zip(g.tolist(), h.tolist())],
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    rows = docs.select(column(key).cast("bigint").alias("id"), column(text).alias("text"))
    found = rows.mapInArrow(
        link,
        "id bigint, a_ids array<int>, b_ids array<int>, "
        "overlaps array<struct<a:int,b:int,bytes:int>>, in_group array<struct<a:int,b:int>>",
    )
    return found.withColumnRenamed("id", key)
