from __future__ import annotations

import numpy as np
import pytest

from paperloom.llm import quality_classifier, toxicity
from paperloom.llm.queries import queries


def _auc(y, s):
    y, s = np.array(y), np.array(s)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean()) if len(a) and len(b) else 1.0


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.8), ("op6_quality_classifier", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = queries()[name](spark, sf)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert _auc([r[label] for r in rows], [r["score"] for r in rows]) >= least
    assert out.count() == 1000


def _edges(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "you idiot", "z"), (4, "word " * 30000, "z")], "doc_id long, text string, score string")


def test_quality_edges(spark):
    docs, labels = _edges(spark), spark.createDataFrame([(1, 1), (2, 0), (4, None)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    assert quality_classifier.score(docs, model).count() == 5
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    assert quality_classifier.keep_good(docs, model, 0.0).columns == docs.columns
    assert quality_classifier.keep_good(docs, model, 0.0).count() == 5
    assert quality_classifier.train(docs.limit(0), labels.limit(0)).offset == 0.0


def test_toxicity_edges(spark):
    docs, labels = _edges(spark), spark.createDataFrame([(1, 1), (2, 0), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.score(docs).count() == 5
    assert toxicity.train(docs.limit(0), labels.limit(0)).score(docs.limit(0)).count() == 0


def test_toxicity_features_see_through_obfuscation():
    x = toxicity.features(["you are an 1d1ot", "you are an id*ot", "you are an i.d.i.o.t", "you are a reader", ""], {}, {})
    assert (x[:3, toxicity.NAMES.index("hidden")] == 1).all()
    assert not x[3:, toxicity.NAMES.index("any")].any()
