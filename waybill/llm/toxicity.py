"""Toxic spans by a linear-chain conditional random field over words.

1. Sample. The model is fitted on about ``TOXIC`` toxic and ``CLEAN`` clean labelled documents,
   drawn by a hash of their keys, of up to ``LONGEST`` characters each (a longer one is not
   used for fitting); equal texts are taken once. Everything else covers all documents.
2. Labelled tokens. Labels are given by document, so tokens get theirs from a cover: of the words
   and word beginnings that are rare in clean documents, take the one that most toxic documents
   hold, and so on while ``LEAST`` or more hold it; a document with ``SIGNS`` of them counts no
   more, and a sign for documents that have one already must be a frequent one. A token of a toxic document is labelled toxic if it has one of these features.
3. Field. Two states; a token's features are the word, its beginnings and end, and the words
   before and after it, hashed to ``SLOTS`` weights. Weights and transitions maximize the
   likelihood of the labels in stretches of the sample's texts, with a square penalty.
4. Marginals. Forward-backward over the whole text. Both recursions are products of 2 x 2
   matrices, taken in blocks: within all blocks of a batch side by side, then over blocks.
5. Documents. The score is a logistic function, fitted on the sample, of the largest marginal
   and of the expected number of toxic tokens. Offending offsets are runs of tokens with a
   marginal of ``SPAN`` or more, in characters.

The sample is fitted in one task, whose input does not grow with the corpus; its weights (2 MB)
are broadcast.

Defined results: null and empty texts, and texts without words, get the score of a text without
toxic tokens; null labels, null keys and labels of unknown documents are not learned from; a
key with several labels is toxic if one of them is 1; without toxic or without clean documents
every score is 0; rows that repeat a key are scored one by one; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import column
from waybill.llm.words import mix

TOXIC, CLEAN, LONGEST = 2000, 4000, 50_000
LEAST, PRECISION, SIGNS = 4, 0.97, 3
SLOTS = 1 << 18
STRETCH, MARKED, OTHERS = 40, 3, 1  # tokens of a stretch; a document's stretches with and without labels
STEPS, PENALTY = 40, 0.02
SPAN, THRESHOLD = 0.5, 0.7
BLOCK = 64
MEMO = 400_000  # words whose weights a worker remembers before it starts afresh

WORD = re.compile(r"[^\W\d_]+|\d+")
_U = np.uint64
_OWN, _BEFORE, _AFTER = 1, 2, 3


def _hashed(features: list[str], kind: int) -> np.ndarray:
    """Slots of features; kind keeps a word apart from the same word beside the token."""
    raw = np.fromiter((zlib.crc32(f.encode()) for f in features), np.int64, len(features))
    return (mix(raw.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(kind)) >> _U(20)).astype(np.int64) % SLOTS


def spellings(word: str) -> list[str]:
    """Features of a word by itself: the word, beginnings and its end."""
    return ["w " + word, *[f"b{k} {word[:k]}" for k in (3, 4, 5, 6) if len(word) >= k], "e " + word[-3:]]


def _lower(text: str | None) -> str:
    """Lower case with every character at its own place."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else "".join(c.lower()[0] for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(_lower(text))


# ---------------------------------------------------------------- labelled tokens


def cover(toxic: list[set[str]], clean: list[set[str]], share: float) -> set[str]:
    """Features that explain the toxic documents, from each document's set of features ``kind
    letters``. share: of toxic documents among all."""
    in_clean: Counter = Counter()
    for features in clean:
        in_clean.update(features)
    holds: dict[str, set[int]] = {}
    for i, features in enumerate(toxic):
        for f in features:
            holds.setdefault(f, set()).add(i)
    # how often a feature's documents are toxic, at the true share of toxic documents
    odds = share / max(1e-9, 1 - share) * max(1, len(clean)) / max(1, len(toxic))
    least = lambda n, m: n >= LEAST and odds * n >= PRECISION * (odds * n + m)
    fine = {f: at for f, at in holds.items() if least(len(at), in_clean[f])}
    # what a feature adds only shrinks, so the first that keeps its number is the best; among
    # equals a word, then the longest beginning
    heap = [(-len(at), f[0] != "w", -len(f), f) for f, at in fine.items()]
    heapq.heapify(heap)
    many = max(2 * LEAST, len(toxic) // 100)
    found, left = [0] * len(toxic), set(range(len(toxic)))
    chosen: set[str] = set()
    while heap:
        gain, *rank, f = heapq.heappop(heap)
        now = len(left & fine[f])
        letters = f.split(" ")[1]
        # one sign for the same word is enough
        if now < LEAST or any(letters.startswith(x) or x.startswith(letters)
                              for x in (c.split(" ")[1] for c in chosen)):
            continue
        if now < -gain:
            heapq.heappush(heap, (-now, *rank, f))
            continue
        # a further sign of explained documents must be a frequent one
        if len(fine[f]) < many and sum(not found[i] for i in left & fine[f]) < LEAST:
            continue
        chosen.add(f)
        for i in left & fine[f]:
            found[i] += 1
            if found[i] == SIGNS:
                left.discard(i)
    return chosen


# ---------------------------------------------------------------- forward and backward


def marginals(
    emission: np.ndarray, first: np.ndarray, transition: np.ndarray, steps: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Probability of state 1 at every token of chains put end to end, and, if asked for, the
    expected number of steps between each two states.

    emission: log weight of state 1 over state 0; first: whether a token begins a chain;
    transition: log weights of (state before, state). Exact, in time linear in the tokens.
    """
    if not len(emission):
        return np.zeros(0), np.zeros((2, 2))
    e = np.clip(emission, -30, 30)
    weight = np.exp(np.minimum(0, -e)), np.exp(np.minimum(0, e))
    move = np.exp(transition - transition.max())
    last = np.append(first[1:], True)
    a0, a1 = _prefixes(*weight, first, move)
    b0, b1 = (x[::-1] for x in _prefixes(weight[0][::-1], weight[1][::-1], last[::-1], move.T))
    on, off = a1 * b1 / weight[1], a0 * b0 / weight[0]
    counts = np.zeros((2, 2))
    if steps:
        at = np.flatnonzero(~first)
        joint = np.stack([
            x[at - 1] * move[i, j] * y[at] for i, x in enumerate((a0, a1)) for j, y in enumerate((b0, b1))
        ])
        counts = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    return on / (on + off), counts


def _prefixes(w0: np.ndarray, w1: np.ndarray, first: np.ndarray, move: np.ndarray):
    """Scaled forward weights of both states at every token: a token's step is the matrix
    move * weight, or, at the first of a chain, one that forgets what was before."""
    n = len(w0)
    blocks = -(-n // BLOCK)

    def dealt(x, fill):
        """Place in the block by block."""
        out = np.full(blocks * BLOCK, fill, np.float64)
        out[:n] = x
        return np.ascontiguousarray(out.reshape(blocks, BLOCK).T)

    w = dealt(w0, 1.0), dealt(w1, 1.0)
    begins = dealt(first, 0.0).astype(bool)
    step = [[np.where(begins, 1.0, move[i, j]) * w[j] for j in (0, 1)] for i in (0, 1)]
    # products within the blocks: from state i at the block's start to state j
    held = np.empty((2, 2, BLOCK, blocks))
    now = [[np.ones(blocks) if i == j else np.zeros(blocks) for j in (0, 1)] for i in (0, 1)]
    for k in range(BLOCK):
        for i in (0, 1):
            x, y = now[i]
            now[i] = [x * step[0][j][k] + y * step[1][j][k] for j in (0, 1)]
        if k % 8 == 7:
            most = np.maximum(np.maximum(now[0][0], now[0][1]), np.maximum(now[1][0], now[1][1]))
            now = [[x / most for x in row] for row in now]
        held[0, 0, k], held[0, 1, k], held[1, 0, k], held[1, 1, k] = (*now[0], *now[1])
    starts = np.empty((2, blocks))
    s0 = s1 = 1.0
    for k, (p, q, r, t) in enumerate(held[:, :, -1].reshape(4, -1).T.tolist()):
        starts[:, k] = s0, s1
        s0, s1 = s0 * p + s1 * r, s0 * q + s1 * t
        most = max(s0, s1)
        s0, s1 = s0 / most, s1 / most
    out = [starts[0] * held[0, j] + starts[1] * held[1, j] for j in (0, 1)]
    most = np.maximum(*out)
    return [(x / most).T.reshape(-1)[:n] for x in out]


# ---------------------------------------------------------------- fitting


def _slots(ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(token, slot) of all features of a text's tokens."""
    features = [spellings(w) for w in ws]
    at = [np.repeat(np.arange(len(ws)), [len(f) for f in features])]
    slot = [_hashed([x for f in features for x in f], _OWN)]
    if len(ws) > 1:
        at += [np.arange(1, len(ws)), np.arange(len(ws) - 1)]
        slot += [_hashed(ws[:-1], _BEFORE), _hashed(ws[1:], _AFTER)]
    return np.concatenate(at), np.concatenate(slot)


def fit_field(chains: list[tuple[list[str], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(weights and at last the constant, transition) from labelled chains, by gradient steps of
    adapted length."""
    at, slot, first, labels, n = [], [], [], [], 0
    for ws, tags in chains:
        i, s = _slots(ws)
        at.append((i + n).astype(np.int32))
        slot.append(s.astype(np.int32))
        labels += tags
        first += [True] + [False] * (len(ws) - 1)
        n += len(ws)
    weights, transition, bias = np.zeros(SLOTS), np.zeros((2, 2)), -3.0
    if not n:
        return np.append(weights, bias), transition
    at, slot = np.concatenate(at), np.concatenate(slot)
    first, labels = np.array(first), np.array(labels, np.int64)
    inner = np.flatnonzero(~first)
    seen = np.bincount(2 * labels[inner - 1] + labels[inner], minlength=4).reshape(2, 2)
    squares, move_squares, bias_square = np.full(SLOTS, 1e-8), np.full((2, 2), 1e-8), 1e-8
    for _ in range(STEPS):
        emission = bias + np.bincount(at, weights[slot], minlength=n)
        p, pairs = marginals(emission, first, transition, steps=True)
        slope = np.bincount(slot, (labels - p)[at], minlength=SLOTS) - PENALTY * weights
        move_slope = seen - pairs - PENALTY * transition
        bias_slope = float((labels - p).sum())
        squares += slope**2
        move_squares += move_slope**2
        bias_square += bias_slope**2
        weights += 0.5 * slope / np.sqrt(squares)
        transition += 0.2 * move_slope / np.sqrt(move_squares)
        bias += 0.5 * bias_slope / np.sqrt(bias_square)
    return np.append(weights, bias), transition


def _measures(p: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Per document: largest marginal and logarithm of 1 + the expected number of toxic tokens."""
    n = len(edges) - 1
    out = np.zeros((n, 2))
    some = np.diff(edges) > 0
    if some.any():
        at = edges[:-1][some]
        out[some, 0] = np.maximum.reduceat(p, at)
        out[some, 1] = np.log1p(np.add.reduceat(p, at))
    return out


def fit_scores(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic weights (two measures, constant) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 0.01 * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(3)
        beta = beta + np.linalg.solve(curve, slope)
    beta[:2] = np.maximum(beta[:2], 0)  # more toxic tokens never lower the score
    return beta


def fit(rows: list[tuple[str, int]], share: float) -> bytes:
    """A model from (text, label) rows; share: of toxic documents among all labelled."""
    y = np.array([label for _, label in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return b""
    number: dict[str, int] = {}  # of words
    texts = [np.array([number.setdefault(w, len(number)) for w in words(t)], np.int32)
             for t, _ in rows]
    vocabulary = list(number)
    of_word = [[f for f in spellings(w) if f[0] != "e"] for w in vocabulary]
    held = [{f for w in np.unique(ws).tolist() for f in of_word[w]} for ws in texts]
    signs = cover([h for h, k in zip(held, y) if k], [h for h, k in zip(held, y) if not k], share)
    toxic = np.array([not signs.isdisjoint(fs) for fs in of_word], bool)
    del held
    chains = []
    for ws, label in zip(texts, y.tolist()):
        tags = toxic[ws] & bool(label)
        cuts = range(0, len(ws), STRETCH)
        marked = [i for i in cuts if tags[i : i + STRETCH].any()]
        others = [i for i in cuts if not tags[i : i + STRETCH].any()]
        # spread over the text; unmarked stretches of a toxic document are learned from, too
        for kind, most in ((marked, MARKED), (others, OTHERS)):
            for i in kind[:: max(1, len(kind) // most)][:most]:
                chains.append(([vocabulary[w] for w in ws[i : i + STRETCH].tolist()],
                               tags[i : i + STRETCH].astype(int).tolist()))
    weights, transition = fit_field(chains)
    model = Field(weights, transition, np.zeros(3))
    measured = np.concatenate([model.measured([t for t, _ in rows[i : i + 500]])[0]
                               for i in range(0, len(rows), 500)])
    of = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    beta = fit_scores(measured, y, of)
    return np.concatenate([transition.ravel(), beta, weights]).astype("<f8").tobytes()


# ---------------------------------------------------------------- the model


class Field:
    """Fitted weights, and the words met so far."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, beta: np.ndarray):
        self.weights, self.bias = weights[:-1], float(weights[-1])
        self.transition, self.beta = transition, beta
        self.known: dict[str, int] = {}
        self.held = np.zeros((0, 3))  # a word's own weight, as the one before, as the one after

    def _places(self, texts: list[list[str]]) -> np.ndarray:
        known = self.known
        if len(known) > MEMO:
            known.clear()
            self.held = self.held[:0]
        flat = [w for ws in texts for w in ws]
        new = [w for w in dict.fromkeys(flat) if w not in known]
        if new:
            features = [spellings(w) for w in new]
            at = np.repeat(np.arange(len(new)), [len(f) for f in features])
            slots = _hashed([x for f in features for x in f], _OWN)
            own = np.bincount(at, self.weights[slots], minlength=len(new))
            beside = [self.weights[_hashed(new, kind)] for kind in (_BEFORE, _AFTER)]
            known.update(zip(new, range(len(self.held), len(self.held) + len(new))))
            self.held = np.concatenate([self.held, np.column_stack([own, *beside])])
        return np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of all words of texts put end to end, and where each text begins and ends."""
        edges = np.concatenate([[0], np.cumsum([len(ws) for ws in texts])]).astype(np.int64)
        at = self._places(texts)
        first = np.zeros(len(at), bool)
        first[edges[:-1][np.diff(edges) > 0]] = True
        emission = self.bias + self.held[at, 0]
        if len(at) > 1:
            inner = ~first[1:]
            emission[1:][inner] += self.held[at[:-1][inner], 1]
            emission[:-1][inner] += self.held[at[1:][inner], 2]
        return marginals(emission, first, self.transition)[0], edges

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, edges = self.marginals([words(t) for t in texts])
        return _measures(p, edges), p, edges

    def scored(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and the offending runs as (start, end, probability) in characters."""
        x, p, edges = self.measured(texts)
        score = 1 / (1 + np.exp(-np.clip(x @ self.beta[:2] + self.beta[2], -30, 30)))
        spans: list[list[dict]] = [[] for _ in texts]
        for k in np.flatnonzero(x[:, 0] >= SPAN).tolist():
            own, last = p[edges[k] : edges[k + 1]], -2
            for i, m in enumerate(WORD.finditer(_lower(texts[k]))):
                if own[i] < SPAN:
                    continue
                if i == last + 1:
                    span = spans[k][-1]
                    span["end"], span["p"] = m.end(), max(span["p"], float(own[i]))
                else:
                    spans[k].append({"start": m.start(), "end": m.end(), "p": float(own[i])})
                last = i
        return score, spans


@lru_cache(2)
def _model(raw: bytes) -> Field:
    flat = np.frombuffer(raw, "<f8")
    return Field(flat[7:], flat[:4].reshape(2, 2), flat[4:7])


def fitted(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
           label: str = "toxic") -> bytes:
    """The model of (key, text) rows and their (key, label) rows; empty if there are not both kinds."""
    known = labels.select(column(key).alias("__key"), column(label).cast("int").alias("__y"))
    known = known.filter("__key IS NOT NULL AND __y IN (0, 1)").groupBy("__key").agg(
        F.max("__y").alias("y")
    )
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    # by a hash of the key: about as many as asked for, so few that they can be broadcast
    parts = 1 << 30
    keep = {y: int(parts * min(1.0, most / max(1, n.get(y, 0)))) for y, most in ((0, CLEAN), (1, TOXIC))}
    drawn = F.pmod(F.xxhash64(F.col("__key").cast("string")), F.lit(parts))
    few = known.filter(drawn < F.when(F.col("y") == 1, keep[1]).otherwise(keep[0]))
    rows = docs.select(column(key).alias("__id"), column(text).alias("text"))
    rows = rows.filter(F.length("text").between(1, LONGEST))
    found = rows.join(F.broadcast(few), F.col("__id") == F.col("__key"))
    sample = found.groupBy("text").agg(F.max("y").alias("y"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = sorted((r["text"], r["y"]) for batch in batches for r in batch.to_pylist())
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit(taken, share)], pa.binary())})

    models = sample.repartition(1).mapInArrow(learn, "model binary").collect()
    return max((bytes(r.model) for r in models), key=len, default=b"")


def toxic_scores(docs: DataFrame, model: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, spans) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, spans = np.zeros(len(texts)), [[] for _ in texts]
            if shared.value:
                found, spans = _model(shared.value).scored(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(found, pa.float64()), pa.array(spans, pa.list_(span))],
                names=["id", "score", "spans"],
            )

    rows = docs.select(column(key).alias("id"), column(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(score, f"id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")
    return out.withColumnRenamed("id", key)
