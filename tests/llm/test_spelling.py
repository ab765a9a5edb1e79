from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import spelling
from paperloom.llm.common import stage


def plain_counts(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_variants(n):
    """Near words by deleted and replaced places of every word."""
    at = {}
    for w in n:
        for i in range(len(w)):
            at.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            near[w] |= at[w[:i], w[i + 1 :]]
            if (short := w[:i] + w[i + 1 :]) in n:
                near[w].add(short)
                near[short].add(w)
        near[w].discard(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def _check(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, spelling.op13(df, **how).collect()), key=repr) == plain_variants(plain_counts(docs))


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "12 34"), (None, "Straße STRASSE straße straße"), (4, "Éclair éclair Éclair éclair É" * 3), (5, "ÀÿàŸ" * 3), (6, "abcde abcdf 日本abcde" * 3), (6, "x×y÷z " * 9), (7, "letter leter letters lettre " * 4 + "letter " * 50)]
    docs += [(i, "colour color colours colors" * 2) for i in range(300)] + [(9, "w" * 40000 + " ") for _ in range(3)]
    _check(spark, docs)
    _check(spark, docs[:0])


@pytest.mark.parametrize("how", [{}, {"block_words": 1}, {"block_words": 10**6, "slice_words": 16}])
def test_dense_words(spark, how):
    """Short words over few letters: nearly all have near words, and chains of forms."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcé"), rng.integers(4, 8))) for _ in range(700)]
    docs = [(i, " ".join(rng.choice(words, 200, p=(p := 1 / np.arange(1, 701)) / p.sum()))) for i in range(100)]
    _check(spark, docs, **how)


def test_chain_of_forms(spark):
    words = [("chainaaaa", 1), ("chainaaab", 2), ("chainaabb", 4), ("chainabbb", 8), ("chainbbbb", 16), ("chaincbbb", 32), ("hainc", 1)]
    got = spelling.group_variants(stage(spark.createDataFrame(words, "word string, n long"), "words")).collect()
    assert {r["word"]: r["root"] for r in got} == {w: "chaincbbb" if len(w) == 9 else w for w, _ in words}


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "tests tests tests", "x", 3, True)], "doc_id long, text string, word string, n long, guest boolean")
    assert [tuple(r) for r in spelling.op13(df).collect()] == [("tests", None, "tests", 3, 0, None)]


def test_query(spark, sf):
    from paperloom.llm.queries import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op13_spelling"](spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(plain_counts(docs))
