"""Benchmark decontamination (operator 12): a generalised suffix automaton of the test items.

Every training text is streamed word by word through the automaton, which gives after each word the
longest stretch ending there that some item holds. Stretches of `window` words, and items shorter
than that as a whole, are hits; hit spans are cut out, and documents mostly made of hits go.

The automaton is built from one block of items of a fixed size at a time, so what is broadcast and
held in memory does not grow with the benchmark; more items mean more passes over the texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

WINDOW = 10
#: Bytes of item words in one automaton.
BLOCK_BYTES = 2 << 20
#: Longer items are cut into pieces of so many words that overlap by a window less one word.
PIECE_WORDS = 4096

#: ASCII letters in lower case, digits and all other characters stay, the rest separates. Byte by byte, so offsets hold.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ADDED = {"n_words": pa.int64(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "longest": pa.int64(), "items": pa.list_(pa.string())}
_ADDED_FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("longest", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of many word sequences: each state stands for stretches that end at the same places of the items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.least = window, min([window, *(len(w) for _, w in items if w)])
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items]
        for _, ids in numbered:
            at = 0
            for c in ids:
                at = self._extend(at, c)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: The ancestor that holds just the last `window` words, and which items hold them.
        self.window_state = [0] * len(self.next)
        for v in order:
            if self.length[v] >= window:
                self.window_state[v] = self.window_state[self.link[v]] or v
        self.holders: dict[int, set[str]] = {}
        for name, ids in numbered:
            at = 0
            for c in ids:
                at = self.next[at][c]
                if u := self.window_state[at]:
                    self.holders.setdefault(u, set()).add(name)
            if 0 < len(ids) < window:
                self.holders.setdefault(at, set()).add(name)
        #: The nearest state on the way to the root, itself included, that is a whole short item.
        self.short_state = [0] * len(self.next)
        for v in order:
            self.short_state[v] = v if self.length[v] < window and v in self.holders else self.short_state[self.link[v]]

    def _new(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the stretches of `p` followed by `c`, parted from longer ones if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], int, set[str]]:
        """Merged hit spans of word numbers [start, end), the longest matching length, the items met."""
        following, link, length, least, window = self.next, self.link, self.length, self.least, self.window
        spans: list[list[int]] = []
        met, longest, v, matched = set(), 0, 0, 0
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                v = matched = 0
                continue
            t = following[v].get(c)
            while t is None and v:
                v = link[v]
                matched = length[v]
                t = following[v].get(c)
            if t is None:
                continue
            v, matched = t, matched + 1
            if matched < least:
                continue
            longest = max(longest, matched)
            size = 0
            if matched >= window:
                size = window
                met.add(self.window_state[v])
            u = self.short_state[v]
            if u and length[u] > matched:
                u = self.short_state[link[u]]
            while u:
                size = max(size, length[u])
                met.add(u)
                u = self.short_state[link[u]]
            if size:
                start = i + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return spans, longest, set().union(*(self.holders[u] for u in met))


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> tuple[DataFrame, int]:
    """`block, item, words` and the number of blocks: items in pieces, dealt by a running sum of their bytes."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                    piece = b" ".join(words[at : at + PIECE_WORDS + window - 1])
                    if piece:
                        out.append((name, at, piece, len(piece)))
            names = ["item", "at", "words", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.string(), pa.int64(), pa.binary(), pa.int64()])], names=names)

    chosen = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    p = stage(chosen.mapInArrow(pieces, "item string, at long, words binary, bytes long").distinct(), "items")
    buckets = 1 + p.count() // 100_000
    p = p.withColumn("bucket", F.pmod(F.xxhash64("item", "at"), F.lit(buckets)))
    sums = p.groupBy("bucket").agg(F.sum("bytes").alias("sum")).withColumn("before", F.sum("sum").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum"))
    local = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("item", "at", "words").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    p = stage(p.withColumn("local", local).join(sums, "bucket").select(((F.col("before") + F.col("local")) / block_bytes).cast("long").alias("block"), "item", "words"), "item-blocks")
    return p, 1 + (p.agg(F.max("block")).first()[0] or 0)


_BUILT: dict[str, Automaton] = {}


def _scanner(block: DataFrame, window: int):
    """A function that gives the automaton of one block, built once in each worker process."""
    rows = [(r["item"], bytes(r["words"])) for r in block.collect()]  # at most BLOCK_BYTES and a piece
    shared, name = block.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def automaton() -> Automaton:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Automaton([(item, words.split(b" ")) for item, words in shared.value], window)
        return _BUILT[name]

    return automaton


def find_hits(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of `docs`: the row as struct `row`, n_words, starts and ends (word numbers of hit spans), longest, items.

    `longest` is the longest matching length in one block of items (0 below the shortest window), `items` are the
    distinct ids, as text, of items with a window that occurs; a null id counts as the empty text. Null and empty texts have no words;
    items without words match nothing; equal rows give equal results. An empty benchmark gives no hits.
    """
    blocks, n = item_blocks(items, item_id_col, item_text_col, window, block_bytes)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("binary").alias("words"))
    if n > 1:  # equal rows have equal hits
        d = d.withColumn("key", F.sha2(F.to_json("row"), 256))
    out = _pass(d, blocks.filter(F.col("block") == 0), window, every=True)
    if n == 1:
        return out
    more = [_pass(d.drop("row"), blocks.filter(F.col("block") == k), window, every=False) for k in range(1, n)]
    hits = reduce(DataFrame.unionByName, more).distinct()  # a row for each text with hits and block
    hits = hits.groupBy("key").agg(*[F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("starts", "ends", "items")], F.max("longest").alias("more_longest"))
    return _merged(out.join(hits, "key", "left").drop("key"), out.drop("key").schema)


def _pass(docs: DataFrame, block: DataFrame, window: int, every: bool) -> DataFrame:
    """Scans `words` of all rows with the automaton of one block; rows without hits stay only if `every`."""
    automaton = _scanner(block, window)
    rest = [f for f in docs.schema.fields if f.name != "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for b in batches:
            kept, out = [], {c: [] for c in _ADDED}
            for i, text in enumerate(b.column(b.schema.get_field_index("words"))):
                words = words_of(text.as_py())
                spans, longest, names = found.scan(words)
                if every or spans:
                    kept.append(i)
                    for c, v in zip(_ADDED, (len(words), [s for s, _ in spans], [e for _, e in spans], longest, sorted(names)), strict=True):
                        out[c].append(v)
            rows = b.select([f.name for f in rest]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(out[c], t) for c, t in _ADDED.items())], names=[*rows.schema.names, *_ADDED])

    return docs.mapInArrow(run, T.StructType([*rest, *_ADDED_FIELDS]))


def _merged(both: DataFrame, schema: T.StructType) -> DataFrame:
    """Joins the hits of later blocks to those of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {c: [] for c in _ADDED}
            for r in b.drop_columns(["row"]).to_pylist():
                spans: list[list[int]] = []
                for s, e in sorted(zip(r["starts"] + (r["more_starts"] or []), r["ends"] + (r["more_ends"] or []), strict=True)):
                    if spans and spans[-1][1] >= s:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                names = sorted({*r["items"], *(r["more_items"] or [])})
                for c, v in zip(_ADDED, (r["n_words"], [s for s, _ in spans], [e for _, e in spans], max(r["longest"], r["more_longest"] or 0), names), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("row")), *(pa.array(out[c], t) for c, t in _ADDED.items())], names=["row", *_ADDED])

    return both.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", max_coverage: float = 0.5, **how) -> DataFrame:
    """The rows of `docs` without their hit spans; a document with more than `max_coverage` of its words in hits goes.

    A span is cut from its first word to the end of its last; texts without hits stay as they are. Columns are those of `docs`.
    """
    found = find_hits(docs, items, text_col=text_col, **how)
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["starts"])
    kept = found.filter(n_hit <= max_coverage * F.col("n_words"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        def of(t: str, spans: list[tuple[int, int]]) -> str:
            raw = t.encode()
            places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_FOLD))]
            out, at = b"", 0
            for s, e in spans:
                out += raw[at : places[s][0]]
                at = places[e - 1][1]
            return (out + raw[at:]).decode()

        return pd.Series([of(t, list(zip(s, e, strict=True))) for t, s, e in zip(text, starts, ends, strict=True)], dtype=object)

    text = F.col("row").getField(text_col)
    hit = F.size("starts") > 0
    new = F.coalesce(cut(F.when(hit, text).otherwise(""), F.when(hit, F.col("starts")).otherwise(F.array().cast("array<long>")), F.when(hit, F.col("ends")).otherwise(F.array().cast("array<long>"))), F.lit(""))
    return kept.select(*[F.when(hit, new).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op12(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The contract's digest of `find_hits`."""
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda a, x: a + x["ends"] - x["starts"])
    out = find_hits(docs.select("doc_id", "text"), items, **how).withColumn("n_hit", n_hit)
    return out.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
