"""Packing documents into fixed-length token sequences (operator 9).

Method: shortest-pack-first over the length histogram. The histogram has at most
`max_len` entries, so the plan is made from counts alone; documents meet their
place in the plan again by their rank among the pieces of equal length.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, stage

END_ID = 1
#: Ranks among pieces of one length are counted per salt first, so that one very
#: frequent length is never ranked by a single task.
SALTS = 256


def encoder(ranks_path: str, pattern: str, special: dict[str, int]):
    """The byte-level BPE given by a rank file; strings in `special` are read as their ids."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


_ENCODERS: dict = {}


def _encode(name: str):
    """Encoder of a public vocabulary, one per worker process.

    The rank file holds the same vocabulary as the JSON file of that name; it gives
    the same ids about four times as fast (tests hold the two against each other).
    """
    if name not in _ENCODERS:
        import public_tokenizers as P

        _ENCODERS[name] = encoder(P.path(f"{name}.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256})
    enc = _ENCODERS[name]
    return lambda text: enc.encode(text, allowed_special="all")


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_len: int = 2048, tokenizer: str = "byte_bpe_50k", end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row per piece of at most `max_len` tokens: doc_id, start, length, ids_crc32, doc_tokens[, ids].

    A document is its tokens followed by `end_id`; null text counts as empty, so every
    document has at least one token. Rows with the same id (or null) are packed as separate documents.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.uint32())))
        ddl += ", ids array<int>"
        fields[-1] = ("ids", pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encode(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for at in range(0, len(ids), max_len):
                    piece = ids[at : at + max_len]
                    row = [doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)]
                    if keep_ids:
                        row.append(piece.astype(np.int32))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def plan_patterns(histogram: dict[int, int], max_len: int) -> list[tuple[int, dict[int, int]]]:
    """Shortest-pack-first: (count, {length: how often}) patterns that use up the histogram.

    Lengths are placed from the longest down. Open packs are kept by free space, as
    (count, pattern); each placing takes the pack with the most free space that fits,
    for as many copies at once as pack and length both have.
    """
    open_packs: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    spaces: list[int] = []  # free spaces that have open packs, ascending
    done: list[tuple[int, dict[int, int]]] = []

    def put(space: int, count: int, pattern: dict[int, int]) -> None:
        if space == 0:
            done.append((count, pattern))
            return
        if not open_packs[space]:
            bisect.insort(spaces, space)
        open_packs[space].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if spaces and spaces[-1] >= length:
                space = spaces[-1]
                have, pattern = open_packs[space].pop()
                if not open_packs[space]:
                    spaces.pop()
                # as many of this length as keep the pack the shortest one
                used = min(have, left)
                if have > used:
                    put(space, have - used, pattern)
                put(space - length, used, pattern | {length: pattern.get(length, 0) + 1})
                left -= used
            else:
                # fresh packs: the open one is the only one that fits until it is full
                times = max_len // length
                if left >= times:
                    put(max_len - times * length, left // times, {length: times})
                if left % times:
                    put(max_len - left % times * length, 1, {length: left % times})
                left = 0
    for packs in open_packs.values():
        done.extend(packs)
    return done


def slots(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, first offset, copies per sequence): ranks lo..hi-1 of that length."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, times in sorted(pattern.items(), reverse=True):
            lo = taken[length]
            taken[length] = hi = lo + count * times
            out.append((length, lo, hi, sequence, offset, times))
            offset += length * times
        sequence += count
    return out


def pack(pieces: DataFrame, max_len: int = 2048, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to staged pieces (`doc_id, start, length, ...`).

    The histogram (at most `max_len` rows) and the slots made from it are the only
    things that pass through the driver, whatever the corpus size. An empty table gives an empty result.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = pieces.sparkSession
    rows = slots(plan_patterns(histogram, max_len))
    schema = "length long, lo long, hi long, first_sequence long, first_offset long, times long"
    # Bounded: a function of max_len alone (histogram entries and the packs they split).
    places = F.broadcast(spark.createDataFrame(rows, schema))
    ranked = gapless_rank(pieces, ["length"], [], ["doc_id", "start"], "rank", salts)
    hit = (ranked["length"] == places["length"]) & (ranked["rank"] >= places["lo"]) & (ranked["rank"] < places["hi"])
    at = F.col("rank") - F.col("lo")
    return (
        ranked.join(places, hit)
        .withColumn("sequence_id", F.col("first_sequence") + F.floor(at / F.col("times")).cast("long"))
        .withColumn("offset", F.col("first_offset") + (at % F.col("times")) * ranked["length"])
        .select(*[ranked[c] for c in pieces.columns], "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, *, max_len: int = 2048, tokenizer: str = "byte_bpe_50k", keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its place; `ids` has the tokens themselves."""
    pieces = stage(tokenize(docs, max_len=max_len, tokenizer=tokenizer, keep_ids=keep_ids), "pieces")
    return pack(pieces, max_len)
