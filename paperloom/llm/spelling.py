"""Spelling variant grouping (operator 13): blocked Gram matrices of letter counts.

Words one edit apart have letter counts at squared distance at most two. Words are dealt into blocks
by length and by their counts in a few classes of letters; one edit moves a word to the same block or
an adjacent one, so only adjacent blocks meet. Within a pair of blocks a NumPy product of the count
matrices gives all squared distances at once, and the few pairs at most two apart are verified.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

#: ASCII letters in lower case and the letters from U+00C0 on stay, the rest separates (Latin-1 bytes).
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Distinct words a task gathers before it hands its counts on.
FLUSH = 1 << 17
#: Words of a block that meet others at once; larger blocks have several slices.
SLICE = 512
#: Words that a block should have about.
BLOCK_WORDS = 256


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", every: int = 97, min_chars: int = 5) -> DataFrame:
    """`word, n` of all texts: partial counts of each task summed. Null ids count as the empty text in the crc32.

    Where `every` divides the crc32 of `<id>:<run>`, the code point at crc32 % length is deleted from a run first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])
            tally.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for w, n in Counter((text.as_py() or "").encode("latin-1", "replace").translate(_FOLD).split()).items():
                    if len(w) < min_chars:
                        continue
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % every == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < min_chars:
                            continue
                    tally[w] += n
                if len(tally) > FLUSH:
                    yield flush()
        yield flush()

    part = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _counts(letters: np.ndarray, width: int, of: np.ndarray) -> np.ndarray:
    """How often each row has each of `width` letters or classes; `of` numbers the bytes."""
    rows = np.arange(len(letters))[:, None] * width + of[letters]
    return np.bincount(rows.ravel(), minlength=len(letters) * width).reshape(len(letters), width)


def _classes(k: int) -> np.ndarray:
    return np.arange(256) % k


def near_pairs(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of words one edit apart: between `a` and `b` (of its length or one more letter), or within `a` once each."""
    # a column for each letter that occurs
    seen = np.bincount(np.concatenate([a.ravel(), a.ravel() if b is None else b.ravel()]), minlength=256) > 0
    column, width = np.cumsum(seen) - 1, int(seen.sum())
    x = _counts(a, width, column).astype(np.float32)
    y = x if b is None else _counts(b, width, column).astype(np.float32)
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(squared <= 2.5)  # whole numbers
    if b is None:
        i, j, b = i[i < j], j[i < j], a
    p, q = a[i], b[j]
    if a.shape[1] == b.shape[1]:
        good = (p != q).sum(1) == 1
    else:  # q has one letter more: an equal head and an equal tail make up all of p
        head = np.cumprod(p == q[:, :-1], 1).sum(1)
        tail = np.cumprod((p == q[:, 1:])[:, ::-1], 1).sum(1)
        good = head + tail >= a.shape[1]
    return i[good], j[good]


def _moves(k: int) -> np.ndarray:
    """Steps from a word's block to those where it is a guest: a letter less, or one moved to a later class."""
    less = -np.eye(k, dtype=np.int64)
    moved = [less[i] - less[j] for i in range(k) for j in range(i + 1, k)]
    return np.array([*less, *moved])


def _keys(counts: np.ndarray) -> pa.Array:
    """Class counts as binary block keys."""
    width = 4 * counts.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(counts), [None, pa.py_buffer(counts.astype("<u4").tobytes())]).cast(pa.binary())


def _packs(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """`block, slice, words, ns`: the words of a slice, all of one length, end to end in Latin-1, and their counts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("block", "slice", "word", "n")), strict=True)

        packs = ((key, [*found]) for key, found in groupby(rows(), key=lambda r: r[:2]))
        while some := [*islice(packs, 256)]:
            columns = [[k[0] for k, _ in some], [k[1] for k, _ in some], ["".join(r[2] for r in f).encode("latin-1") for _, f in some], [np.array([r[3] for r in f], "<i8").tobytes() for _, f in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "slice", "words", "ns"])

    dealt = words.join(sizes, "block").withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")).select("block", "slice", "word", "n")
    return dealt.repartition("block", "slice").sortWithinPartitions("block", "slice").mapInArrow(pack, "block binary, slice int, words binary, ns binary")


def near_words(words: DataFrame, *, block_words: int = BLOCK_WORDS, slice_words: int = SLICE) -> DataFrame:
    """`word, n, near, near_n` for every ordered pair of words one edit apart. `words` (`word, n`, each word once) must be staged.

    A slice of a block meets the later slices of its block and all slices of the adjacent blocks; it is held
    by one task while those pass by, so memory does not depend on how many words a block has.
    """
    total = words.count()
    # more words: more classes, so that blocks stay about as large; the result does not depend on it
    k = max(2, min(10, round(math.log(max(1, total / block_words), 3))))
    of, moves = _classes(k), _moves(k)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoded = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            length, own = np.array([len(w) for w in encoded], np.int64), np.zeros((len(encoded), k), np.int64)
            for size in np.unique(length):
                mine = np.nonzero(length == size)[0]
                own[mine] = _counts(_letters([encoded[i] for i in mine]), k, of)
            yield pa.RecordBatch.from_arrays([_keys(own), *b.columns], names=["block", "word", "n"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(b.num_rows, k).astype(np.int64)
            at = own[:, None, :] + moves[None]
            row, step = np.nonzero(at.min(2) >= 0)
            guests = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*guests.columns, _keys(at[row, step])], names=["block", "slice", "at"])

    own = stage(words.select("word", "n").mapInArrow(block, "block binary, word string, n long"), "blocks")
    sizes = stage(own.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / slice_words).cast("int").alias("slices")), "sizes")
    packs = stage(_packs(own, sizes), "packs")
    # which slice goes where, before any words move: blocks without words get no guests
    to = sizes.withColumnRenamed("block", "at")
    plan = packs.select("block", "slice")
    every = lambda upto: F.explode(F.sequence(F.lit(0), upto)).alias("host")
    guests = plan.mapInArrow(visit, "block binary, slice int, at binary").join(to, "at").select("block", "slice", "at", every(F.col("slices") - 1))
    met = plan.select("block", "slice", F.col("block").alias("at"), every(F.col("slice"))).union(guests)
    met = met.withColumn("guest", (F.col("block") != F.col("at")) | (F.col("slice") != F.col("host")))
    met = packs.join(met, ["block", "slice"]).select("at", "host", "guest", "block", "words", "ns")
    met = met.repartition("at", "host").sortWithinPartitions("at", "host", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("at", "host", "guest", "block", "words", "ns")), strict=True)

        def meet(host: _Words, guests: list[_Words]) -> pa.RecordBatch:
            other = _Words(np.concatenate([g.letters for g in guests]), np.concatenate([g.ns for g in guests])) if guests else host
            i, j = near_pairs(host.letters, other.letters if guests else None)
            a, b, m, n = host.texts().take(pa.array(i)), other.texts().take(pa.array(j)), host.ns[i], other.ns[j]
            both = [pa.concat_arrays([a, b]), pa.array(np.concatenate([m, n])), pa.concat_arrays([b, a]), pa.array(np.concatenate([n, m]))]
            return pa.RecordBatch.from_arrays(both, names=["word", "n", "near", "near_n"])

        for _, found in groupby(rows(), key=lambda r: r[:2]):
            host, waiting = _Words.of(*next(found)[3:]), {}
            yield meet(host, [])
            for *_, key, blob, ns in found:
                guest = _Words.of(key, blob, ns)
                side = waiting.setdefault(guest.letters.shape[1], [])
                side.append(guest)
                if sum(len(g.ns) for g in side) >= 4 * SLICE:
                    yield meet(host, side)
                    side.clear()
            for side in waiting.values():
                if side:
                    yield meet(host, side)

    return met.mapInArrow(run, "word string, n long, near string, near_n long")


@dataclass
class _Words:
    """Words of one length as rows of letters, and how often they occur."""

    letters: np.ndarray
    ns: np.ndarray

    @classmethod
    def of(cls, block: bytes, words: bytes, ns: bytes) -> _Words:
        length = int(np.frombuffer(block, "<u4").sum())
        return cls(np.frombuffer(words, np.uint8).reshape(-1, length), np.frombuffer(ns, "<i8"))

    def texts(self) -> pa.Array:
        width = self.letters.shape[1]
        whole = self.letters.tobytes().decode("latin-1")
        return pa.array([whole[i : i + width] for i in range(0, len(whole), width)], pa.string())


def group_variants(words: DataFrame, *, ratio: int = 2, **how) -> DataFrame:
    """`word, n, n_near, form, form_n, root` of staged `words` (`word, n`).

    A form is the near word of largest n (ties: smallest in code-point order) if that is at least `ratio` times the
    word's n. `root` follows forms to the last: every round jumps twice as far, and as n grows by `ratio`
    on each step there are few rounds. An empty table gives no row.
    """
    best = near_words(words, **how).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    fits = F.col("near_n") >= ratio * F.col("n")
    near = stage(near.select("word", "n", "n_near", F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")), "near")
    jump = stage(near.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(jump.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        jump = longer.select("word", "root")
        if not longer.filter("moved").limit(1).count():
            break
    return near.join(jump, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13(docs: DataFrame, **how) -> DataFrame:
    words = stage(word_counts(docs).filter("n >= 3"), "words")
    return group_variants(words, **how).select("word", "form", "root", "n", "n_near", "form_n")
