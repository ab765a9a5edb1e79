"""Operators that SQL cannot state, against plain versions of their rules."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import ann, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, toxicity
from paperloom.llm.common import sample_ids, table
from paperloom.llm.queries import op5, op10

from .brute import WORD
from .test_packing import _ids


def test_toxicity_features_by_all_pairs():
    rng = np.random.default_rng(4)
    words = ["you", "idiot", "the", "dein", "trash", "nice", "badword", "meh", "TRASH", "reader,"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 40))) for _ in range(50)]
    got = toxicity.features(texts, {"badword": 3.0}, {"meh": 0.9})
    at = {n: i for i, n in enumerate(toxicity.NAMES)}
    for t, row in zip(texts, got, strict=True):
        low = [w.strip(",").lower() for w in t.split()]
        n = max(1, len(low))
        bad = [i for i, w in enumerate(low) if w in toxicity.SEED_LEXICON | {"badword", "meh"}]
        you = [i for i, w in enumerate(low) if w in toxicity.SECOND_PERSON]
        assert math.isclose(row[at["seed"]], sum(w in toxicity.SEED_LEXICON for w in low) / n)
        assert math.isclose(row[at["strong"]], low.count("badword") / n) and math.isclose(row[at["mild"]], low.count("meh") / n)
        near = sum(1 / (1 + min(abs(i - j) for j in you)) for i in bad) if you else 0.0
        assert math.isclose(row[at["near_you"]], near)


def _isotonic(x, y):
    """Pool adjacent violators: (margin, value) of every sample in order."""
    at = defaultdict(list)
    for a, b in zip(x, y, strict=True):
        at[a].append(b)
    blocks = [[sum(v), len(v), [k] * len(v)] for k, v in sorted(at.items())]
    out = []
    for b in blocks:
        out.append(b)
        while len(out) > 1 and out[-2][0] / out[-2][1] >= out[-1][0] / out[-1][1]:
            s, n, k = out.pop()
            out[-1] = [out[-1][0] + s, out[-1][1] + n, out[-1][2] + k]
    return [(k, s / n) for s, n, ks in out for k in ks]


def test_toxicity_calibration(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.train(docs, labels)
    # the calibrating fifth again, from the rule in the docstring
    rows = labels.filter(~toxicity.held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)
    d = docs.join(rows.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    x = toxicity._raw(model.trees, model.calibration, toxicity.feature_frame(d, model.lexicon, ["y"])).collect()
    want = dict(_isotonic([r["margin"] for r in x], [r["y"] for r in x]))
    for r in x:
        assert abs(r["calibrated"] - want[r["margin"]]) < 1e-9
        assert abs(r["score"] - r["calibrated"]) <= toxicity.ORDER
    # what the lexicons hold was not chosen with the calibrating fifth
    assert model.lexicon == toxicity.learn_lexicon(docs.select("doc_id", "text").join(labels.filter(~toxicity.held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(5)) != 0)).select("doc_id", F.col("toxic").alias("y")), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text")))
    out = model.score(docs).join(labels.filter(toxicity.held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)), "doc_id").collect()
    for lo, hi in ((0.0, 0.5), (0.5, 1.01)):  # reliability on held-out labels
        own = [(r["score"], r["toxic"]) for r in out if lo <= r["score"] < hi]
        if own:
            p, y = np.mean(own, axis=0)
            assert abs(p - y) <= 0.1 + 2 * math.sqrt(0.25 / len(own))


def test_quality_scores_by_plain_densities(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_classifier.train(docs, labels)
    rows = [r for r in docs.join(labels.select("doc_id", "quality").filter(~quality_classifier.held_out(F.col("doc_id"))), "doc_id").collect() if r["quality"] in (0, 1)]
    x = quality_classifier.statistics([r["text"] for r in rows])
    y = np.array([r["quality"] for r in rows])
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3)
    pooled = np.diag(sum((y == k).sum() * z[y == k].var(axis=0) for k in (0, 1)) / len(z) + 1e-3)
    every = docs.collect()
    e = (quality_classifier.statistics([r["text"] or "" for r in every]) - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-3)
    log = []
    for k in (0, 1):
        own = z[y == k]
        c = 0.85 * np.cov(own, rowvar=False) + 0.15 * pooled
        d = e - own.mean(axis=0)
        log.append(-0.5 * (np.einsum("ij,ij->i", d, np.linalg.solve(c, d.T).T) + np.linalg.slogdet(c)[1]))
    u = np.tanh((log[1] - log[0]) / 40) * 40
    want = 1 / (1 + np.exp(-np.clip(model.slope * u + model.offset, -35, 35)))
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    assert max(abs(got[r["doc_id"]] - w) for r, w in zip(every, want, strict=True)) < 1e-6
    assert model.slope > 0


def test_shards_cut_no_more_links_than_plain_filling(spark):
    """Links: consecutive rows of one text. The plain version fills shards with whole groups, largest first."""
    sf = "/root/testdata/sf0.01"
    rows = op5(spark, sf).collect()
    of = defaultdict(list)
    for r in rows:
        of[r["text_crc32"], r["size"]].append(r["shard"])
    groups = [g for g in of.values() if len(g) > 1]
    links = sum(len(g) - 1 for g in groups)
    cut = sum(len(set(g)) - 1 for g in groups)
    room = [math.ceil(len(rows) / 8)] * 8
    plain = 0
    for g in sorted(groups, key=len, reverse=True):
        left = len(g)
        while left:
            s = max(range(8), key=lambda k: room[k])
            take = min(left, room[s])
            room[s], left = room[s] - take, left - take
            plain += left > 0
    assert cut <= plain + 0.2 * links


def test_mixture_by_plain_budgets(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    words = {d: len(WORD.findall(r["text"] or "")) for d, r in docs.items()}
    total = Counter()
    for d, r in docs.items():
        total[r["source"]] += words[d]
    p = np.array(list(total.values())) / sum(total.values())
    lo, hi = 0.0, 1.0
    for _ in range(60):  # the flattest weights under which no source is repeated over twice
        a = (lo + hi) / 2
        repeats = p ** (a - 1)
        lo, hi = (a, hi) if repeats.max() / repeats.min() > 2 else (lo, a)
    w = p**hi / (p**hi).sum()
    whole = max(t / x for t, x in zip(total.values(), w, strict=True))
    rows = op10(spark, sf).collect()
    assert all(r["n_tokens"] == words[r["doc_id"]] and r["source"] == docs[r["doc_id"]]["source"] for r in rows)
    for (source, t), x in zip(total.items(), w, strict=True):
        quota = x * whole
        blocks: dict = defaultdict(int)
        order: dict = {}
        for r in rows:
            if r["source"] == source:
                blocks[r["epoch"], r["block"]] += r["n_tokens"]
                order[r["epoch"], r["block"]] = r["mix_order"]
        at = 0
        for key in sorted(blocks, key=lambda k: (k[0], order[k])):  # places follow from the order of the blocks
            at = max(at, key[0] * t)
            if blocks[key]:
                assert abs(order[key] - (at + blocks[key] / 2) / quota) < 1e-5
            at += blocks[key]
        assert abs(at - quota) <= max(blocks.values()) / 2 + 1e-4 * quota
        assert {b for e, b in blocks if e == 0} == {b for _, b in blocks}


def test_ids_of_all_documents_and_odd_texts(spark):
    rng = np.random.default_rng(1)
    pool = [chr(c) for c in (*range(1, 128), 0xA0, 0xAD, 0x85, 0x1680, 0x2003, 0x2028, 0x200B, 0x200D, 0x202F, 0x3000, 0xFEFF, 0xE9, 0x301, 0x4E2D, 0x645, 0x1F600, 0x1F1E6, 0x10FFFF, 0xFFFD, 0x660, 0xB2, 0x2160)]
    odd = ["".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(1500)] + [a + b for a in pool for b in ("  x", "'s", "\n\n", " 1")]
    odd += ["<|endoftext|>" * 3, "a<|endoftext|>b", "<|endoftext", "I'LL don't", " " * 300, "\t\n \r\n" * 40]
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = defaultdict(list)
    for r in packing.tokenize(docs).collect():
        got[r["doc_id"]].append((r["start"], r["ids"]))
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = docs.collect()
    for r, e in zip(rows, t.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False), strict=True):
        assert [x for _, p in sorted(got[r["doc_id"]]) for x in p] == [*e.ids, 1], r["text"]
    assert _ids("x")[-1] == packing.END_ID


def test_one_frequent_length(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"))
    rows = packing.pack_documents(df, max_len=16, keep_ids=False).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3000 and max(r["sequence_id"] for r in rows) == 3000 // 5 - 1


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(3 if i % 3 else 5).tolist()) for i in range(240)] + [(1000, [1.0])]
    got = defaultdict(list)
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    x = dict(rows)
    hits = []
    for q in (i for i in x if i % 20 == 0 and i < 1000):
        near = sorted((-np.dot(x[q], x[i]), i) for i in x if i != q and len(x[i]) == len(x[q]))[:20]
        assert len(got[q]) == 20 and {len(x[i]) for i in got[q]} == {len(x[q])}
        hits.append(len({i for _, i in near} & set(got[q])) / 20)
    assert np.mean(hits) >= 0.9 and 1000 not in got


def test_equal_scores_of_different_vectors(spark):
    rows = [(0, [1.0, 0.0])] + [(i, [0.5, float(i)]) for i in range(1, 40)]
    got = [r["vec_id"] for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == list(range(1, 21))


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, b = ({r["k"] for r in sample_ids(x, "k", 500).collect()} for x in (df.repartition(3), df.repartition(17)))
    assert a == b and len(a) == 500


CLASH = "doc_id long, text string, source string, n_chars int, row int, _s int, _b int, _id int, _v int, _text int, of int, block int, epoch int, removed_lines int, salt int, version int, n_words int"


@pytest.mark.parametrize("n", [0, 3])
def test_user_columns_with_the_operators_own_names(spark, n):
    rows = [(1, "a b c\nd\ne", "x", 9, *range(13)), (2, "a b c\nd\ne", "y", 9, *range(13)), (None, None, None, None, *range(13))][:n]
    df = spark.createDataFrame(rows, CLASH)
    own = lambda out: sorted(map(repr, out.select(df.columns).collect()))
    assert own(mixing.mixed_documents(df)) == own(df) or mixing.mixed_documents(df).count() >= n
    assert mixing.mixed_documents(df).columns == df.columns
    kept = mixing.mix(df)
    assert kept.columns == [c for c in df.columns if c not in mixing.ADDED] + mixing.ADDED
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == df.columns and own(out) == own(df.filter("doc_id is null or doc_id = 1"))
    clean = quality_rules.clean_lines(df)
    assert {"_text", "row", "kept", "salt"} <= set(clean.columns) and clean.count() == n
    assert [r["_text"] for r in clean.collect()] == [5] * n
    assert near_dedup.drop_near_duplicates(df).columns == df.columns
