from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    """Every window of every item against every place of every text."""
    windows = {}
    for item, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item) if item is not None else "")
    sizes, out = {len(x) for x in windows}, []
    for doc, text in docs:
        w, hit, met = _words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    met |= found
        out.append((doc, len(w), len(hit), len(met), sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _check(spark, docs, items, **how):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontamination.op12(d, i, **how).collect()), key=repr) == plain(docs, items, how.get("window", 10))


LONG = "The quick brown Fox jumps over a lazy dog, and then it SLEEPS for 12 hours - ÜBER all."


def test_edges(spark):
    items = [(1, LONG), (2, "short Item, this"), (3, None), (4, "..."), (None, "no id here"), (2, "short item this"), (5, "x"), (6, LONG.lower()), (7, "ITEM this")]
    docs = [(1, None), (2, ""), (3, "- _"), (4, LONG), (5, "a " * 9), (6, f"see: {LONG[5:]}!"), (7, "short\nitem\nthis x"), (8, "no id here no id here"), (None, LONG), (4, LONG), (9, "word " * 50000 + LONG), (10, "brown fox jumps over a lazy dog and then it brown fox jumps over a lazy dog and then it")]
    _check(spark, docs, items)
    _check(spark, docs, [])
    _check(spark, docs[:0], items)
    _check(spark, docs, items, block_bytes=40)


@pytest.mark.parametrize("how", [{"window": 4}, {"window": 3, "block_bytes": 100}])
def test_few_words(spark, how):
    """A small vocabulary, so that stretches repeat within and across items, states split and matches fall back."""
    rng = np.random.default_rng(5)
    text = lambda n, k: " ".join(rng.choice(list("abcdefgh"[:k]), n))
    items = [(i, text(rng.integers(1, 30), 2 + i % 5)) for i in range(60)]
    docs = [(i, text(rng.integers(0, 60), 3 + i % 6)) for i in range(300)]
    _check(spark, docs, items, **how)


def test_long_items_are_cut(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 5)
    words = [f"w{i}" for i in range(40)]
    _check(spark, [(i, " ".join(["z", *words[i : i + 11], "z"])) for i in range(35)], [(1, " ".join(words))])


def test_removal(spark):
    docs = spark.createDataFrame([(1, f"Before this. {LONG} After that, {'more words ' * 20}", "x"), (2, LONG, "y"), (3, "clean", "z"), (4, None, "n")], "doc_id long, text string, n_words string").withColumn("row", F.lit(1))
    items = spark.createDataFrame([("a", LONG)], "id string, q string")
    out = decontamination.decontaminate(docs, items, item_id_col="id", item_text_col="q")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: f"Before this. . After that, {'more words ' * 20}", 3: "clean", 4: None}


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "a b c d z"), (2, "b c"), (3, "q")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x a b c d y"), (2, "b c d e")], "item_id long, text string")
    got = decontamination.find_hits(docs, items, window=2).select("row.doc_id", "longest", "items").collect()
    assert {r["doc_id"]: (r["longest"], r["items"]) for r in got} == {1: (4, ["1", "2"]), 2: (2, ["1", "2"]), 3: (0, [])}


def test_query(spark, sf):
    from paperloom.llm.queries import queries

    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()]
    got = queries()["op12_decontamination"](spark, sf)
    want = plain(read("documents", ["doc_id", "text"]), read("benchmark", ["item_id", "text"]))
    assert sorted(map(tuple, got.collect()), key=repr) == want and any(r[-1] for r in want)
