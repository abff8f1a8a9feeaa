"""The pipeline against its stages applied one by one in plain Python."""

from collections import Counter

from test_native import counts
from test_near_dup import brute as classes
from test_tokens import SF, ids_of

import corpus_pipeline
from waybill.llm.pii import pseudonymize
from waybill.llm.quality import STOP_WORDS


def clean(text):
    n, chars, symbols, dup, repeated = counts(text)
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    stops = sum(w.decode().lower() in STOP_WORDS for w in (text or "").encode().split())
    return (n >= 50 and repeated <= 0.5 * n and 2 * n <= chars <= 16 * n and symbols <= 0.1 * n
            and stops >= 0.01 * n and dup <= 0.5 * len(lines)
            and sum(x.strip()[0] in "-*•‣·" for x in lines) <= 0.9 * len(lines)
            and sum(x.rstrip().endswith(("...", "…")) for x in lines) <= 0.5 * len(lines))


def test_pipeline_equals_plain_stages(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good = {r.doc_id: r for r in rows if clean(r.text)}
    root = classes([(d, r.text) for d, r in good.items()])
    once = {d: r for d, r in good.items() if root[d] == d}
    texts = {d: pseudonymize(r.text)[0] for d, r in once.items()}
    out = corpus_pipeline.run(spark, SF).collect()
    # whole documents come out, up to three times each, near their source's target
    by_doc = {}
    for p in out:
        by_doc.setdefault(p.doc_id, []).append(p)
    times = {}
    for d, pieces in by_doc.items():
        ids = ids_of(texts[d]) + [0]
        want = b"".join(i.to_bytes(4, "little") for i in ids)
        total = sum(p.length for p in pieces)
        assert total % len(ids) == 0 and 1 <= total // len(ids) <= 3
        times[d] = total // len(ids)
        for p in pieces:
            assert bytes(p.ids) == want[4 * p.start : 4 * (p.start + p.length)]
        starts = Counter(p.start for p in pieces)
        assert set(starts.values()) == {times[d]}
    used = Counter()
    for p in out:
        used[p.sequence_id] += p.length
    assert max(used.values()) <= 1024
    size = {d: len(t.encode().split()) for d, t in texts.items()}
    sources = sorted({r.source for r in once.values()})
    have, took = Counter(), Counter()
    for d, r in once.items():
        have[r.source] += size[d]
        took[r.source] += size[d] * times.get(d, 0)
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    level = sum(have.values()) / sum(weight.values())
    if all(level * weight[s] <= 3 * have[s] for s in sources):
        for s in sources:
            largest = max(size[d] for d, r in once.items() if r.source == s)
            assert abs(took[s] - level * weight[s]) <= largest


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(30), SF).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
