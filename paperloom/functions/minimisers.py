"""Sampled windows: an index for "some text holds this key", without a row for every place of a text.

Of each stretch as long as a key only the gram with the smallest hash is kept. Equal stretches keep
equal grams and neighbouring stretches mostly share theirs, so about a quarter of the places go into the
index; a key is looked up by its own gram and verified on the text around the places found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of one piece of a long text, and of the pieces worked on at once.
PIECE, AT_ONCE = 1 << 16, 1 << 18


def gram_length(size: int) -> int:
    """At most seven grams in a stretch, and grams of at least half of it."""
    return max((size + 1) // 2, size - 6)


def sample(texts: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(text numbers, grams, contexts) of the sampled places; every stretch of `size` characters lies in the context of its gram."""
    gram = gram_length(size)
    group: list[tuple[int, str]] = []
    held = 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - size + 1, PIECE):
            group.append((row, text[at : at + PIECE + size - 1]))
            held += len(group[-1][1])
            if held >= AT_ONCE:
                yield _places(group, size, gram)
                group, held = [], 0
    if group:
        yield _places(group, size, gram)


def _places(group: list[tuple[int, str]], size: int, gram: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    rows, whole = np.array([r for r, _ in group]), "".join(t for _, t in group)
    length = np.array([len(t) for _, t in group])
    ends = np.cumsum(length)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - gram + 1
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    of = np.repeat(np.arange(len(group)), length)
    starts = np.nonzero(np.arange(len(codes)) + size <= ends[of])[0]
    # the first of equal grams, wherever the stretch stands
    at = np.unique(starts + np.lib.stride_tricks.sliding_window_view(h, size - gram + 1)[starts].argmin(1))
    lo, hi = np.maximum(ends[of[at]] - length[of[at]], at - (size - gram)), np.minimum(ends[of[at]], at + size)
    return rows[of[at]], h[at].view(np.int64), [whole[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def index_texts(texts: DataFrame) -> DataFrame:
    """`doc_id, gram, context` of `texts(doc_id, n, sizes)`: places sampled for each of the key lengths of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, whole, sizes = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            for size in sorted({s for x in sizes for s in x}):
                mine = [i for i, (t, x) in enumerate(zip(whole, sizes, strict=True)) if size in x and len(t) >= size]
                for rows, grams, contexts in sample([whole[i] for i in mine], size):
                    of = docs.take(pa.array(np.array(mine)[rows]))
                    yield pa.RecordBatch.from_arrays([of, pa.array(grams), pa.array(contexts, pa.string())], names=["doc_id", "gram", "context"])

    return texts.select("doc_id", "n", "sizes").mapInArrow(run, "doc_id string, gram long, context string")


def index_keys(keys: DataFrame) -> DataFrame:
    """Adds `gram` to `keys(doc_id, key)`; keys are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(1).to_pylist()
            grams = np.zeros(len(key), np.int64)
            for size in {len(k) for k in key}:
                mine = np.array([i for i, k in enumerate(key) if len(k) == size])
                for rows, found, _ in sample([key[i] for i in mine], size):
                    grams[mine[rows]] = found
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grams)], names=["doc_id", "key", "gram"])

    return keys.select("doc_id", "key").mapInArrow(run, "doc_id string, key string, gram long")
