from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import ann
from paperloom.llm.queries import op2


def _exact(ids, x, queries, k):
    out = {}
    for q in queries:
        s = x @ x[ids == q][0]
        order = [(-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q]
        out[q] = [(int(i), -v) for v, i in sorted(order)[:k]]
    return out


def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    want = _exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    got: dict = {}
    for r in sorted(op2(spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for i, s in near:
            assert abs(s - x[ids == i][0] @ x[ids == q][0]) < 1e-12


def test_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 0.5], "a") for i in range(0, 200)] + [(1000 + i, rng.standard_normal(3).tolist(), "b") for i in range(60)]
    rows += [(2000, None, ""), (2020, [0.0, 0.0, 0.0], ""), (2040, [1.0, None, 1.0], ""), (2060, [float("nan"), 1.0, 1.0], ""), (2080, [float("inf"), 1.0, 1.0], ""), (None, [1.0, 1.0, 1.0], ""), (1000, rows[-60][1], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got: dict = {}
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    good = [r for r in rows[:260]]
    want = _exact(np.array([r[0] for r in good]), np.array([r[1] for r in good]), [r[0] for r in good if r[0] % 20 == 0], 20)
    assert set(got) == set(want)
    for q in range(0, 200, 20):
        assert got[q] == [i for i, _ in want[q]]
    assert np.mean([len(set(got[q]) & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
