from __future__ import annotations

import hashlib
import random

import numpy as np

from paperloom.llm import suffix_dedup as S
from paperloom.llm.queries import op3


def brute(docs, n=50):
    """[(doc_id, text)] to {doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    first: dict = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = True
        left = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def _digest(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["span_starts"]), r["kept_sha256"]) for r in rows}


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for alphabet, size in ((2, 60), (3, 200), (60, 300), (1, 40), (256, 3000)):
        blocks = [bytes(rng.randrange(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(size // 5)]
        x = np.frombuffer(b"".join(blocks), dtype=np.uint8)
        rest = np.concatenate([np.arange(len(b), 0, -1) for b in blocks])
        text = x.tobytes()
        tail = [text[i : i + rest[i]] for i in range(len(x))]
        order = S.suffix_array(x, rest)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: (tail[i], i))
        want = [0] + [next((k for k, (p, q) in enumerate(zip(tail[a], tail[b], strict=False)) if p != q), min(len(tail[a]), len(tail[b]))) for a, b in zip(order[:-1], order[1:], strict=True)]
        assert S.common_prefixes(x, rest, order, lanes=7).tolist() == want


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op3(spark, sf).collect()}
    assert got == brute(docs)


def test_random_passages(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 200))) for _ in range(25)]
    docs = []
    for i in range(120):
        bits = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            bits += [p[a : a + rng.randint(40, 180)], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))]
        docs.append((i, "".join(bits)))
    docs += [(200, "z" * 300), (201, "z" * 120), (202, "z" * 49), (203, "ab" * 60), (204, "ba" * 60), (205, None), (206, "")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    out = S.remove_repeats(df, batch_bytes=3000, shard_bytes=2000).collect()
    assert _digest(out) == brute(docs)
    texts = dict(docs)
    for r in out:
        t = (texts[r["doc_id"]] or "").encode()
        for a, b in sorted(zip(r["span_starts"], r["span_ends"], strict=True), reverse=True):
            t = t[:a] + t[b:]
        assert bytes(r["kept"]) == t


def test_null_repeated_and_empty(spark):
    p = "the same sentence of more than fifty bytes stands in all of these rows, word for word"
    df = spark.createDataFrame([(None, p, 1), (3, p, 1), (3, p, 2), (4, "x" + p, 0)], "doc_id long, text string, n_bytes long")
    rows = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in S.remove_repeats(df).collect())
    assert rows == [(0, 0), (3, 0), (3, 0), (4, len(p))]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_ids_over_the_whole_range(spark):
    """The smallest and the largest long are ids like others, also beside null ones."""
    low, high = -(2**63), 2**63 - 1
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(40))[:80]
    for docs in ([(high, text), (1, text)], [(low, text), (high, text), (None, text)], [(low, text), (low + 1, text + "!"), (high - 1, "x" + text), (high, text)], [(high, text), (high, text), (None, None)]):
        for batch in (1, 10_000):
            df = spark.createDataFrame(docs, "doc_id long, text string")
            rows = S.remove_repeats(df, batch_bytes=batch).collect()
            known = [(d, t) for d, t in docs if d is not None]
            assert _digest([r for r in rows if r["doc_id"] is not None]) == brute(known)
            assert [(r["doc_id"], r["n_removed"]) for r in rows if r["doc_id"] is None] == [(None, 0)] * (len(docs) - len(known))


def test_key_in_very_many_contexts(spark):
    """A hot 20-gram is dealt window by window: no block over one window has it, and the result stays exact."""
    rng = random.Random(4)
    ruler = "=" * 24 + " licence " + "=" * 24
    texts = []
    for i in range(300):
        lead, tail = ("".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(2))
        texts.append(lead + ruler + tail)
        if i % 3 == 0:  # the same surroundings again, cut short on one side
            texts.append(lead[rng.randint(0, 30) :] + ruler + tail[: rng.randint(0, 40)])
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert _digest(S.remove_repeats(df, batch_bytes=4000, shard_bytes=2000).collect()) == brute(docs)

    x = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    _, _, key, mark = S.window_samples(x, ends)
    assert len(np.unique(mark)) > len(np.unique(key))
    bits = 4
    bucket, rest = S._split_key(np.unique(key), bits)
    shared = [{"bucket": int(b), "data": r.tobytes(), "hot": r.tobytes()} for b, r in zip(bucket, rest, strict=True)]
    row = S.pd.Series({"data": S._squeeze(x.tobytes()), "ids": np.arange(len(texts)).tobytes(), "ends": ends.tobytes()})
    _, _, _, first, _, number, keys, blocks = S._find_blocks(row, S.pd.DataFrame(shared), bits)
    assert {len(b) for b in blocks} == {S.LENGTH}
    assert len(first) == sum(max(0, len(t) - S.LENGTH + 1) for t in texts)
    assert all(blocks[k] == x[a : a + S.LENGTH].tobytes() for a, k in zip(first.tolist(), number.tolist(), strict=True))
    assert len(np.unique(keys)) > 0.99 * len(blocks)
