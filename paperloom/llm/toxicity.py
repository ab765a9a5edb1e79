"""Toxicity scores (operator 1): gradient-boosted trees over dense features, isotonic calibration.

Features: densities of a seed lexicon and of two lexicons learned from the training labels,
hits found only after undoing obfuscation, proximity of hits to second-person words, capitals,
punctuation and obfuscation rates. Trees and calibration are pyspark.ml models.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_ids, stage, table
from .quality_classifier import EXCLAIM, LOWER, NEWLINE, PUNCT, SPACE, UPPER, char_classes

#: Insults in English, German, French and Spanish; a start for the learned lexicons.
SEED_LEXICON = frozenset(
    "idiot idiots stupid moron morons loser losers trash scum pathetic worthless clown dumb fool imbecile jerk "
    "dummkopf blödmann trottel abschaum versager idioten imbécile connard débile crétin minable ordure "
    "estúpido imbécil idiota basura perdedor payaso patético".split()
)
#: Second-person words in the same languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None, "+": "t"})
_EDGE = ".,;:!?\"'()[]{}«»“”…|#&%$*<>"
_LETTERS = re.compile(r"[^\W\d_]+")
#: Weight of the trees' margin beside the isotonic output.
ORDER = 0.001
NAMES = ["seed", "strong", "mild", "hidden", "any", "max_weight", "weight", "near_you", "you", "upper", "shouted", "exclaim", "punct", "obfuscated", "log_words", "per_line"]


def features(texts: list[str], strong: dict[str, float], mild: dict[str, float]) -> np.ndarray:
    """One row of len(NAMES) per text; a text without words has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    c = char_classes(texts)
    known = SEED_LEXICON | strong.keys() | mild.keys()
    stars = re.compile("^[^*]+[*]+[^*]+$")
    by_length: dict[int, list[str]] = {}
    for w in SEED_LEXICON | strong.keys():
        by_length.setdefault(len(w), []).append(w)
    for i, t in enumerate(texts):
        raw = t.split()
        n = len(raw)
        if not n:
            continue
        low = t.lower()
        words = _LETTERS.findall(low)
        hidden = odd = 0
        for w in raw:
            if not w.isalpha():
                core = w.strip(_EDGE)
                if core and not core.isalpha() and not core.isdigit() and any(map(str.isalpha, core)):
                    odd += 1
                    core = core.lower()
                    if stars.match(core):
                        gap = re.compile(re.escape(core).replace(r"\*", "."))
                        hidden += any(gap.fullmatch(x) for x in by_length.get(len(core), ()))
                    else:
                        hidden += core.translate(LEET) in known
        seed = s = m = near = shouted = 0.0
        weight = most = 0.0
        you = 0
        if not known.isdisjoint(words):
            at = [k for k, w in enumerate(words) if w in known]
            people = np.array([k for k, w in enumerate(words) if w in SECOND_PERSON])
            you = len(people)
            for k in at:
                w = words[k]
                seed += w in SEED_LEXICON
                s += w in strong
                m += w in mild
                value = strong.get(w, mild.get(w, 1.0))
                weight += value
                most = max(most, value)
                if you:
                    j = np.searchsorted(people, k)
                    gap = min(abs(int(people[x]) - k) for x in (j - 1, j) if 0 <= x < you)
                    near += 1.0 / (1.0 + gap)
            shouted = sum(w.strip(_EDGE).isupper() and w.strip(_EDGE).lower() in known for w in raw)
        letters = c[i, UPPER] + c[i, LOWER]
        chars = c[i].sum() - c[i, SPACE] - c[i, NEWLINE]
        out[i] = (
            seed / n, s / n, m / n, hidden, seed + s + hidden, most, weight / np.sqrt(n), near, you / n,
            c[i, UPPER] / (letters + 1), shouted, c[i, EXCLAIM] / n, c[i, PUNCT] / (chars + 1), odd / n, np.log1p(n), (seed + s) / (c[i, NEWLINE] + 1),
        )
    return out


def learn_lexicon(sample: DataFrame, *, size: int = 300, min_docs: int = 3) -> tuple[dict[str, float], dict[str, float]]:
    """Words of toxic training documents with their log odds: strong (over 2) and mild (over 0.7), `size` at most of each."""
    words = sample.select("y", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).filter(F.length("word") > 1)
    total = sample.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, n = total["t"] or 0, total["n"]
    counts = words.groupBy("word").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("d")).filter(F.col("a") >= min_docs)
    a, b = F.col("a"), F.col("d") - F.col("a")
    odds = F.log((a + 0.5) / F.lit(toxic + 1.0)) - F.log((b + 0.5) / F.lit(n - toxic + 1.0))
    share = F.lit(toxic / n)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("d") * p))).otherwise(0.0)
    ratio = 2 * (part(a, share) + part(b, 1 - share))  # log-likelihood ratio: over 16 hardly comes by chance among all words
    top = counts.select("word", odds.alias("odds"), ratio.alias("ratio")).filter((F.col("odds") > 0.7) & (F.col("ratio") > 16))
    rows = top.orderBy(F.desc("ratio"), "word").limit(2 * size).collect()  # bounded by 2 * size
    strong = {r["word"]: float(r["odds"]) for r in rows if r["odds"] > 2}
    mild = {r["word"]: float(r["odds"]) for r in rows if r["odds"] <= 2}
    return dict(list(strong.items())[:size]), dict(list(mild.items())[:size])


def feature_frame(docs: DataFrame, lexicon: tuple[dict, dict], keep: list[str]) -> DataFrame:
    strong, mild = lexicon

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = features(b["text"].fillna("").tolist(), strong, mild)
            yield pd.concat([b[keep].reset_index(drop=True), pd.Series(list(x), name="x")], axis=1)

    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInPandas(run, f"{ddl}, x array<double>")


class ToxicityModel:
    """Lexicons, trees and calibration; `score` adds a calibrated probability to every row."""

    def __init__(self, lexicon, trees, calibration, constant: float):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id and score of every row; null text is scored as the empty text, null ids pass through."""
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        if self.trees is None:
            return d.select("doc_id", F.lit(self.constant).alias("score"))
        x = feature_frame(d, self.lexicon, ["doc_id"])
        return _raw(self.trees, self.calibration, x).select("doc_id", "score")


def _raw(trees, calibration, x: DataFrame) -> DataFrame:
    out = trees.transform(x.withColumn("features", array_to_vector("x"))).withColumn("margin", F.element_at(vector_to_array("probability"), 2))
    if calibration is None:
        return out
    # the score is the isotonic output; a thousandth of the margin orders documents on one step of it
    out = calibration.transform(out.drop("prediction"))
    return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - ORDER) * F.col("calibrated") + ORDER * F.col("margin"))))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", *, max_rows: int = 16_000, rounds: int = 25, depth: int = 3) -> ToxicityModel:
    """Fit on at most `max_rows` labelled documents outside the held-out fold.

    A fifth of them calibrates and has no part in lexicons and trees, so the isotonic step is fitted
    on margins as they are for documents never seen.

    With fewer than 10 documents of either label the model is a constant, the share of label 1.
    """
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    rows = sample_ids(rows, "doc_id", max_rows)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")  # bounded by max_rows
    d = stage(d.withColumn("hold", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0), "toxic-sample").repartition(8)
    count = {r["y"]: r["n"] for r in d.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    if min(n0, n1) < 10:
        return ToxicityModel(({}, {}), None, None, (n1 + 0.5) / (n0 + n1 + 1.0))
    lexicon = learn_lexicon(d.filter("not hold").select("y", "text"))
    x = feature_frame(d, lexicon, ["hold", "y"]).withColumn("label", F.col("y").cast("double"))
    x = stage(x, "toxic-features").coalesce(2).withColumn("features", array_to_vector("x")).cache()
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7, featuresCol="features", labelCol="label", maxBins=64, subsamplingRate=0.8, minInstancesPerNode=5)
    trees = gbt.fit(x.filter(~F.col("hold")))
    held = _raw(trees, None, x.filter("hold").drop("features")).select("margin", "label")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(held)
    x.unpersist()
    return ToxicityModel(lexicon, trees, calibration, 0.0)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = train(docs, table(spark, sf_dir, "labels")).score(docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
