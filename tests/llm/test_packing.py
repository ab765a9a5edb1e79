from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np

from paperloom.llm import packing
from paperloom.llm.queries import op9

TEXTS = [None, "", "a", "hello world <|endoftext|> again", "naïve café 😀 　 tabs\t\tand\r\nlines", "word " * 5000, "x" * 3000, "it's 3.14!! don't", "\x00\x01 odd"]


def _ids(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def _sound(rows, max_len=2048):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= max_len
    for d in by_doc.values():
        at = 0
        for start, length, total in sorted(d):
            assert start == at
            at += length
        assert at == d[0][2]
    assert sorted(by_seq) == list(range(len(by_seq)))
    return len(by_seq)


def test_ids_equal_the_json_tokenizer(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.pack_documents(df).collect()
    _sound(rows)
    for i, t in enumerate(TEXTS):
        ids = [x for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]) for x in r["ids"]]
        assert ids == _ids(t), t
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]


def test_query(spark, sf):
    rows = op9(spark, sf).collect()
    n = _sound(rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()}
    for r in rows:
        if r["doc_id"] in texts:
            ids = _ids(texts[r["doc_id"]])
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    assert sum(r["length"] for r in rows) >= 0.97 * 2048 * (n - 1)


def test_patterns_use_up_the_histogram():
    rng = np.random.default_rng(3)
    for _ in range(20):
        hist = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 30), rng.integers(1, 40, 30), strict=True)}
        got: dict = defaultdict(int)
        for count, pattern in packing.plan_patterns(hist, 64):
            assert sum(k * v for k, v in pattern.items()) <= 64
            for k, v in pattern.items():
                got[k] += v * count
        assert got == hist


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "same"), (1, "same"), (None, "none")], "doc_id long, text string")
    rows = packing.pack_documents(df, keep_ids=False).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    assert packing.pack_documents(df.limit(0)).count() == 0
