"""Quality classifier (operator 6): regularised quadratic discriminant analysis.

Document statistics are transformed towards normal shape; each class gets a mean and a
covariance shrunk towards the pooled diagonal. The score is the difference of the two
Mahalanobis log-densities, computed with the classes' cached Cholesky factors, brought to
0..1 by a one-dimensional logistic fit.
"""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_ids, table

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is was that it for on with as are this be at by from or an not have had but they which you "
    "der die das und ist nicht ein eine mit von zu den des auf für im sich dem auch er es an werden aus "
    "le la les un une et est de des du en que qui pour dans par sur au avec pas ce il elle ne se "
    "el los las y en del que una por con para no al lo como más su".split()
)
UPPER, LOWER, DIGIT, STOP, PUNCT, SYMBOL, SPACE, NEWLINE, EXCLAIM, OTHER = range(10)
NAMES = [
    "log_words", "log_word_length", "upper", "digit", "stop", "punct", "symbol", "newline", "exclaim",
    "unique", "adjacent_repeat", "line_repeat", "function_words", "top_word",
]


def _classes() -> np.ndarray:
    kind = {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Nd": DIGIT, "Zs": SPACE, "Cc": SPACE}
    table = np.full(65537, OTHER, dtype=np.uint8)
    for code in range(65536):
        cat = unicodedata.category(chr(code))
        table[code] = kind.get(cat, PUNCT if cat[0] == "P" else SYMBOL if cat[0] == "S" else OTHER)
    for char, value in ((".", STOP), ("…", STOP), ("。", STOP), ("!", EXCLAIM), ("?", EXCLAIM), ("\n", NEWLINE), ("#", SYMBOL), ("*", SYMBOL), ("%", SYMBOL), ("&", SYMBOL), ("@", SYMBOL)):
        table[ord(char)] = value
    return table


_TABLE: list[np.ndarray] = []


def char_classes(texts: list[str]) -> np.ndarray:
    """Characters of each class, one row per text."""
    if not _TABLE:
        _TABLE.append(_classes())
    out = np.zeros((len(texts), 10), dtype=np.float64)
    for i, t in enumerate(texts):
        if t:
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            out[i] = np.bincount(_TABLE[0][np.minimum(codes, 65536)], minlength=10)
    return out


def statistics(texts: list[str]) -> np.ndarray:
    """Transformed statistics, one row per text; an empty text has the values of no evidence."""
    c = char_classes(texts)
    w = np.zeros((len(texts), 6))
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if not n:
            continue
        lines = [x for x in t.split("\n") if x]
        seen = set(words)
        top = 0
        if len(seen) < 0.9 * n:
            counts: dict[str, int] = {}
            for x in words:
                counts[x] = counts.get(x, 0) + 1
            top = max(counts.values())
        w[i] = (n, len(seen), sum(map(operator.eq, words, words[1:])), len(lines) - len(set(lines)), sum(map(FUNCTION_WORDS.__contains__, words)), top)
    n, letters, chars = w[:, 0], c[:, UPPER] + c[:, LOWER], c.sum(axis=1) - c[:, SPACE] - c[:, NEWLINE]
    share = lambda k, of: np.log((k + 0.5) / (of + 20.0))  # noqa: E731  a short text says little
    return np.column_stack(
        [
            np.log1p(n), np.log((chars + 5) / (n + 1)), share(c[:, UPPER], letters), share(c[:, DIGIT], chars), share(c[:, STOP], n), share(c[:, PUNCT], n), share(c[:, SYMBOL], n), share(c[:, NEWLINE], n),
            share(c[:, EXCLAIM], n), np.log((w[:, 1] + 5) / (n + 5)), share(w[:, 2], n), share(w[:, 3], n), (w[:, 4] + 2) / (n + 10), share(w[:, 5], n),
        ]
    )


@dataclass
class Discriminant:
    """Fitted model; a few hundred numbers, shipped to the tasks inside the closure."""

    mean: np.ndarray  # (2, d) class means of standardised statistics
    inverse: np.ndarray  # (2, d, d) inverses of the Cholesky factors
    log_det: np.ndarray  # (2,)
    centre: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        d = [-0.5 * ((((z - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) + self.log_det[k]) for k in (0, 1)]
        return d[1] - d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * np.tanh(self.log_odds(x) / 40.0) * 40.0 + self.offset, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.15) -> Discriminant:
    """Class covariances are (1 - shrinkage) own + shrinkage * pooled diagonal. With one class only, its share is the score."""
    centre = x.mean(axis=0) if len(x) else np.zeros(len(NAMES))
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(len(NAMES))
    z = (x - centre) / scale
    d = z.shape[1]
    mean, inverse, log_det = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    own = [z[y == k] for k in (0, 1)]
    if min(map(len, own)) < 2:
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        return Discriminant(mean, np.array([np.eye(d)] * 2), log_det, centre, scale, 0.0, float(np.log(p / (1 - p))))
    pooled = sum(len(o) * o.var(axis=0) for o in own) / len(z) + 1e-3
    for k, o in enumerate(own):
        mean[k] = o.mean(axis=0)
        covariance = (1 - shrinkage) * np.cov(o, rowvar=False) + shrinkage * np.diag(pooled)
        factor = np.linalg.cholesky(covariance)
        inverse[k] = np.linalg.inv(factor)
        log_det[k] = 2 * np.log(np.diag(factor)).sum()
    model = Discriminant(mean, inverse, log_det, centre, scale)
    # logistic fit of the label on the (softly bounded) log-density difference, by Newton steps with a small ridge
    u = np.tanh(model.log_odds(x) / 40.0) * 40.0
    a, b = 0.3, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -35, 35)))
        r, v = p - y, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * u).sum() + 1e-2 * a, r.sum() + 1e-2 * b])
        h = np.array([[(v * u * u).sum() + 1e-2, (v * u).sum()], [(v * u).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    model.slope, model.offset = float(max(a, 0.0)), float(b)
    return model


def _statistics_frame(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = statistics(b["_text"].fillna("").tolist())
            yield pd.concat([b[keep].reset_index(drop=True), pd.Series(list(x), name="x")], axis=1)

    ddl = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("_text")).mapInPandas(run, f"{ddl}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", *, max_rows: int = 20_000, shrinkage: float = 0.15) -> Discriminant:
    """Fit on at most `max_rows` labelled documents outside the held-out fold (a hash picks them if there are more)."""
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("_y"))
    rows = sample_ids(rows, "doc_id", max_rows)
    labelled = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(rows), "doc_id")  # bounded by max_rows
    got = _statistics_frame(labelled, "text", ["_y"]).toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(NAMES))
    return fit(x, got["_y"].to_numpy(dtype=np.int64) if len(got) else np.zeros(0, dtype=np.int64), shrinkage)


def score(docs: DataFrame, model: Discriminant, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0..1) of every row; null text is scored as the empty text, null ids pass through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": model.score(statistics(b["text"].fillna("").tolist()))})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """Rows of `docs` (its columns unchanged) that score at least `threshold`. One pass, no join."""
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    marked = docs.select(whole.alias("_row"), F.col("text").cast("string").alias("_text"))

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(statistics(text.fillna("").tolist())))

    return marked.filter(probability("_text") >= threshold).select("_row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
