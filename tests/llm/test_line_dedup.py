from __future__ import annotations

import random
from collections import defaultdict

from paperloom.llm import line_dedup
from paperloom.llm.queries import op7

BLANK = " \t\n\x0b\x0c\r"


def cut(docs, window, long_words):
    """[(doc_id, text)] to {doc_id: text left}: lines in a run that occurred before, by comparing all runs."""
    lines = {d: [(i, x.strip(BLANK)) for i, x in enumerate((t or "").split("\n")) if x.strip(BLANK)] for d, t in docs}
    seen, gone = set(), defaultdict(set)
    for d in sorted(lines):
        ls = lines[d]
        runs = [(k, window, "run") for k in range(len(ls) - window + 1)] + [(k, 1, "long") for k, (_, x) in enumerate(ls) if len(x.split()) >= long_words]
        for k, n, kind in sorted(runs):
            key = (kind, tuple(x for _, x in ls[k : k + n]))
            if key in seen:
                gone[d].update(i for i, _ in ls[k : k + n])
            seen.add(key)
    return {d: t if d not in gone else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def _run(df, **options):
    out = line_dedup.remove_lines(df, line_dedup.repeated_lines(df, **options))
    return {r["doc_id"]: r["kept_text"] for r in out.collect()}


def test_random_lines(spark):
    rng = random.Random(11)
    for window in (1, 2, 3, 4):
        docs = [(i, "\n".join(rng.choice(["", " ", "a", "b", " b\t", "c", "d d", "e"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        assert _run(df, window=window, long_words=2) == cut(docs, window, 2)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = cut(docs, 3, 20)
    got = {r["doc_id"]: r["n_kept_chars"] for r in op7(spark, sf).collect()}
    assert got == {d: len(t or "") for d, t in want.items()}
    assert any(want[d] != t for d, t in docs)


def test_edges(spark):
    long = "word " * 30
    df = spark.createDataFrame([(1, long, 1), (None, long, 1), (2, None, 1), (3, "", 0), (4, long + "\nx", 5), (4, long + "\nx", 5), (4, long, 9)], "doc_id long, text string, n_chars int")
    rows = sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in line_dedup.drop_repeated_lines(df).collect() if r["text"] is not None)
    assert rows == [(0, long, 1), (1, long, 1), (3, "", 0), (4, "x", 1), (4, "x", 1)]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
