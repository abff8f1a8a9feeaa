"""Spelling variants: words one edit apart, found in a trie of frequency vectors.

1. Words. Every task counts the words of its texts and hands on partial counts, at most
   ``HELD`` words at a time; Spark adds them up.
2. Trie. A word's vector has one count per letter group (``GROUPS``); the words are arranged
   by successive counts, the frequent letters first. Words one edit apart differ in at most
   one group by a surplus of one and in at most one by a deficit of one.
3. Top of the trie. Nodes that hold more than ``SUBTREE`` words are listed with their
   children. There are at most levels * words / SUBTREE of them; they decide alone which
   subtrees a word can reach, so the search is dealt out by subtree. At most ``LISTED`` nodes
   are broadcast; where there would be more, subtrees are made larger.
4. Search. A task builds the trie of its subtree's words and goes through it depth first.
   All words that search there travel together, each with its unspent budget of one surplus
   and one deficit, and drop out where it does not cover the difference.
5. Leaves hold up to ``LEAF`` words, or all with equal vectors. Their words are verified, and
   a task returns one row per searching word that found some: how many, and the best.

A subtree in which all words have equal vectors cannot be split by counts; it is dealt out by
word in parts of about ``SUBTREE``, and whoever reaches it searches all parts.

Defined results: null texts have no words; a null key counts as an empty one where it is part
of the hashed text; rows that repeat a key count each; an empty table has no words; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import column
from waybill.session import stored

LEAST_CHARS, LEAST_COUNT, FACTOR = 6, 5, 5
DELETE_ONE_IN = 199
HELD = 200_000  # distinct words that a task holds before it hands their counts on
SUBTREE, LEAF = 16_384, 256
LISTED = 200_000  # nodes of the top that are broadcast at most; a node takes about 50 bytes

# fixed value: a run of letters, of those that may be long enough
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_CHARS)
# letter groups, in the order of the levels; the last level counts all other letters
GROUPS = ("e", "n", "i", "r", "a", "t", "s", "o", "u", "d", "h", "l", "c", "g", "m",
          "b", "f", "p", "k", "wv", "yz", "jxq", "àáâãäå", "èéêë", "ìíîïòóôõö", "ùúûüýÿ")

_LEVEL = np.full(0x100, len(GROUPS), np.int64)
for _i, _group in enumerate(GROUPS):
    _LEVEL[[ord(_c) for _c in _group]] = _i
LEVELS = len(GROUPS) + 1


def words_of(key: object, text: str | None) -> Iterator[tuple[str, int]]:
    """The text's words and how often each occurs: lower-cased runs, some with a letter deleted."""
    if not text:
        return
    # bytes have A-Z alone in lower case
    lowered = text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode()
    start = zlib.crc32(b"%s:" % ("" if key is None else str(key)).encode())
    for run, n in Counter(RUN.findall(lowered)).items():
        h = zlib.crc32(run.encode(), start)
        if h % DELETE_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_CHARS:
                continue
        yield run, n


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text",
                least: int = LEAST_COUNT, held: int = HELD) -> DataFrame:
    """(word, n) of the words with ``least`` occurrences or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts):
            return pa.RecordBatch.from_pydict({
                "word": pa.array(list(counts), pa.string()),
                "n": pa.array(list(counts.values()), pa.int64()),
            })

        counts: Counter = Counter()
        for batch in batches:
            for k, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in words_of(k, t):
                    counts[word] += n
                if len(counts) >= held:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    rows = docs.select(column(key).cast("string").alias("id"), column(text).alias("text"))
    parts = rows.mapInArrow(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def vectors(words: list[str]) -> np.ndarray:
    """Counts of the letter groups, a row per word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    at = row * LEVELS + _LEVEL[np.minimum(codes, 0xFF)]
    return np.bincount(at, minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def marks_of(counts: np.ndarray) -> np.ndarray:
    """Two bits per level: one letter or more, two or more."""
    bits = np.uint64(1) << np.arange(2 * LEVELS, dtype=np.uint64)
    some = np.concatenate([counts > 0, counts > 1], axis=1)
    return (some * bits[None, :]).sum(axis=1, dtype=np.uint64)


def ends_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last three letters, as numbers. A single edit leaves the first or the
    last half of a word as it is."""
    half = LEAST_CHARS // 2
    code = lambda parts: np.frombuffer(
        "".join(parts).encode("utf-32-le"), "<u4").reshape(-1, half).astype(np.int64) @ (
            np.int64(1) << np.arange(0, 8 * half, 8))
    empty = np.zeros(0, np.int64)
    if not words:
        return empty, empty
    return code([w[:half] for w in words]), code([w[-half:] for w in words])


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class Top:
    """The nodes that hold many words, and their children: a subtree begins at a child that
    holds few."""

    def __init__(self, nodes: dict[tuple[int, ...], int], subtree: int):
        self.nodes, self.subtree = nodes, subtree  # path -> number of words

    def splits(self, path: tuple[int, ...]) -> bool:
        return len(path) < LEVELS and self.nodes.get(path, 0) > self.subtree

    def parts(self, path: tuple[int, ...]) -> int:
        """1, or more for a node of equal vectors that counts cannot split."""
        return max(1, -(-self.nodes.get(path, 0) // self.subtree))

    def home(self, counts: tuple[int, ...]) -> tuple[int, ...]:
        depth = 0
        while self.splits(counts[:depth]):
            depth += 1
        return counts[:depth]

    def reached(self, counts: tuple[int, ...], seen=(), plus: bool = True, minus: bool = True):
        """Paths of the subtrees with words that a word can reach within the budget."""
        if not self.splits(seen):
            yield seen
            return
        c = counts[len(seen)]
        for step in (0, 1, -1):
            if (step == 1 and not plus) or (step == -1 and not minus):
                continue
            ahead = (*seen, c + step)
            if ahead in self.nodes:
                yield from self.reached(counts, ahead, plus and step != 1, minus and step != -1)


def _spell(path) -> str:
    return ",".join(map(str, path))


def top_of(words: DataFrame, subtree: int = SUBTREE, listed: int = LISTED) -> Top:
    """The nodes with more than ``subtree`` words and their children."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(batch.column("word").to_pylist()).tolist()
            yield pa.RecordBatch.from_pydict({"v": pa.array(found, pa.list_(pa.int32()))})

    distinct = words.select("word").mapInArrow(counted, "v array<int>").groupBy("v").count()
    depths = F.sequence(F.lit(0), F.lit(LEVELS))
    prefixes = distinct.select(
        F.explode(F.transform(depths, lambda d: F.slice("v", F.lit(1), d))).alias("path"), "count"
    )
    nodes = stored(prefixes.groupBy("path").agg(F.sum("count").alias("n")), "nodes")
    while True:
        big = nodes.filter(F.col("n") > subtree).select(F.col("path").alias("__path"))
        parent = F.slice("path", F.lit(1), F.size("path") - 1)
        children = nodes.filter(F.size("path") > 0).join(big, parent == F.col("__path"), "left_semi")
        root = nodes.filter(F.size("path") == 0)
        found = root.unionByName(children).limit(listed + 1).collect()
        if len(found) <= listed:
            return Top({tuple(r.path): r.n for r in found}, subtree)
        subtree *= 4


class Subtree:
    """Trie of the words of one subtree, by their counts below it."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.vectors = vectors(words)
        self.marks, self.ends = marks_of(self.vectors), ends_of(words)

    def search(self, asking: list[str], own: np.ndarray, depth: int, budget: np.ndarray):
        """(place in asking, place in words) of words one edit apart. own: vectors of the asking
        words; budget: their unspent surplus and deficit after ``depth`` levels."""
        out: list[tuple[int, int]] = []
        marks, ends = marks_of(own), ends_of(asking)

        def descend(level, held, rows, plus, minus):
            if not len(held) or not len(rows):
                return
            if level == LEVELS or len(held) <= LEAF:
                self._leaf(held, rows, own, marks, ends, asking, out)
                return
            counts = self.vectors[held, level]
            wants = own[rows, level]
            for c in np.unique(counts):
                spent = c - wants
                go = (spent == 0) | ((spent == 1) & plus) | ((spent == -1) & minus)
                if go.any():
                    spent = spent[go]
                    descend(level + 1, held[counts == c], rows[go],
                            plus[go] & (spent != 1), minus[go] & (spent != -1))

        descend(depth, np.arange(len(self.words)), np.arange(len(asking)),
                budget[:, 0].astype(bool), budget[:, 1].astype(bool))
        return out

    def _leaf(self, held, rows, own, marks, ends, asking, out):
        """Marks first: a surplus and a deficit change one each. Then the words' ends, the
        vectors, and the letters."""
        for at in range(0, len(rows), 4096):
            part = rows[at : at + 4096]
            apart = np.bitwise_count(marks[part][:, None] ^ self.marks[held][None, :])
            i, j = np.nonzero(apart <= 2)
            i, j = part[i], held[j]
            alike = (ends[0][i] == self.ends[0][j]) | (ends[1][i] == self.ends[1][j])
            i, j = i[alike], j[alike]
            rest = self.vectors[j] - own[i]
            fine = (np.maximum(rest, 0).sum(axis=1) <= 1) & (np.maximum(-rest, 0).sum(axis=1) <= 1)
            for a, b in zip(i[fine].tolist(), j[fine].tolist()):
                if one_edit(asking[a], self.words[b]):
                    out.append((a, b))


def near_words(words: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words, from (word, n) rows;
    best is the near word of largest n, of equal ones the smallest."""
    words = stored(words, "words")
    top_nodes = top_of(words, subtree)
    nodes = words.sparkSession.sparkContext.broadcast((top_nodes.nodes, top_nodes.subtree))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row where the word lives, and one wherever it searches."""
        top = Top(*nodes.value)
        for batch in batches:
            out: list[tuple] = []
            names = batch.column("word").to_pylist()
            found = map(tuple, vectors(names).tolist())
            for word, n, counts in zip(names, batch.column("n").to_pylist(), found):
                home = top.home(counts)
                part = zlib.crc32(word.encode()) % top.parts(home)
                out.append((_spell(home), part, False, word, n))
                for path in set(top.reached(counts)):
                    for part in range(top.parts(path)):
                        out.append((_spell(path), part, True, word, n))
            path, part, asks, word, n = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_pydict({
                "path": pa.array(path, pa.string()), "part": pa.array(part, pa.int32()),
                "asks": pa.array(asks, pa.bool_()), "word": pa.array(word, pa.string()),
                "n": pa.array(n, pa.int64()),
            })

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a subtree's words, then those that search it."""
        of, tree, held, ns, asking = None, None, [], [], []

        def found():
            nonlocal tree, asking
            if held and asking:
                tree = tree or Subtree(held, ns)
                path = tuple(map(int, of[0].split(","))) if of[0] else ()
                own = vectors(asking)
                spent = np.array(path, np.int32)[None, :] - own[:, : len(path)]
                budget = 1 - np.stack([np.maximum(spent, 0).sum(axis=1),
                                       np.maximum(-spent, 0).sum(axis=1)], axis=1)
                best: dict[int, tuple] = {}
                for i, j in tree.search(asking, own, len(path), budget):
                    count, n, name = best.get(i, (0, -1, ""))
                    if (-ns[j], held[j]) < (-n, name):
                        n, name = ns[j], held[j]
                    best[i] = (count + 1, n, name)
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([asking[i] for i in best], pa.string()),
                    "n_near": pa.array([x[0] for x in best.values()], pa.int64()),
                    "best_n": pa.array([x[1] for x in best.values()], pa.int64()),
                    "best": pa.array([x[2] for x in best.values()], pa.string()),
                })
            asking = []

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("path", "part", "asks", "word", "n")]
            for path, part, asks, word, n in zip(*cols):
                if (path, part) != of:
                    yield from found()
                    of, tree, held, ns = (path, part), None, [], []
                if asks:
                    asking.append(word)
                    if len(asking) >= 8192:
                        yield from found()
                else:
                    held.append(word)
                    ns.append(n)
        if of is not None:
            yield from found()

    placed = words.mapInArrow(deal, "path string, part int, asks boolean, word string, n bigint")
    order = ["path", "part", "asks", "word"]
    dealt = placed.repartition("path", "part").sortWithinPartitions(*order)
    parts = dealt.mapInArrow(search, "word string, n_near bigint, best_n bigint, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("low"), F.col("best").alias("word")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select(
        "word", "n_near", (-F.col("first.low")).alias("best_n"), F.col("first.word").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, from (word, form) rows: the form's form, and so
    on. A form is ``FACTOR`` times as frequent, so paths end, and halving them takes a few rounds."""
    ahead = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = ahead.select(F.col("word").alias("__of"), F.col("root").alias("__next"))
        joined = ahead.join(step, F.col("root") == F.col("__of"), "left")
        now = joined.select("word", F.coalesce("__next", "root").alias("root"),
                            F.col("__next").isNotNull().alias("moved"))
        now = stored(now, "roots")
        ahead = now.select("word", "root")
        if now.filter("moved").isEmpty():
            return ahead


def spelling_variants(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST_COUNT,
    factor: int = FACTOR,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the texts."""
    words = stored(word_counts(docs, key, text, least), "counted")
    near = near_words(words).withColumnRenamed("word", "__word")
    fits = F.col("best_n") >= F.lit(factor) * F.col("n")
    found = words.join(near, F.col("word") == F.col("__word"), "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(fits, F.col("best")).alias("form"),
        F.when(fits, F.col("best_n")).alias("form_n"),
    )
    found = stored(found, "forms")
    ends = roots(found.filter("form IS NOT NULL")).select(F.col("word").alias("__word"), "root")
    return found.join(ends, F.col("word") == F.col("__word"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
