from __future__ import annotations

from collections import Counter

import corpus_pipeline as P
from paperloom.llm.common import stage, table

from .brute import near
from .test_line_dedup import cut
from .test_packing import _ids


def test_stages(spark, sf):
    assert [len(s) for s in P.STAGES] == [2] * 5
    before = table(spark, sf, "documents")
    columns = before.columns
    out = {}
    docs = before
    for name, f in P.STAGES:
        docs = stage(f(spark, docs, sf), "test")
        if name != "packing":
            assert docs.columns == columns
        out[name] = docs
    rows = {k: [r.asDict() for r in v.collect()] for k, v in out.items()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    kept = {r["doc_id"] for r in rows["quality classifier"]}
    seen = [d for d in labels if labels[d] is not None]
    assert sum((d in kept) == bool(labels[d]) for d in seen) >= 0.95 * len(seen)
    want = cut([(r["doc_id"], r["text"]) for r in rows["quality classifier"]], 3, 20)
    was = {r["doc_id"]: r["text"] for r in rows["quality classifier"]}
    want = {d: t for d, t in want.items() if (t or "").split() or t == was[d]}
    assert {r["doc_id"]: r["text"] for r in rows["line dedup"]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows["line dedup"])
    groups = near([(r["doc_id"], r["text"]) for r in rows["line dedup"]], 5, 80)
    assert {r["doc_id"] for r in rows["near duplicates"]} == {d for d, (_, c) in groups.items() if c == d}
    copies = Counter(r["doc_id"] for r in rows["mixing"])
    assert set(copies) == {r["doc_id"] for r in rows["near duplicates"]} and max(copies.values()) <= 2
    texts = {r["doc_id"]: r["text"] for r in rows["mixing"]}
    for d in list(texts)[:30]:
        got = [r for r in rows["packing"] if r["doc_id"] == d]
        assert sum(r["length"] for r in got) == copies[d] * len(_ids(texts[d]))


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
