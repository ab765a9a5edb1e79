"""Bounded chunks of documents for model requests, prompts, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold

MAX_CHARS, MAX_REQUESTS, MAX_PROMPT = 8_000, 64, 23_000


def _pieces(lengths: np.ndarray, costs: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(chunk, node, from, to): nodes are taken in whole runs by searching the running cost; only a node that does not fit is split."""
    total = np.r_[0, np.cumsum(lengths + costs)]
    chunk, used, i, n, filled = 0, 0, 0, len(lengths), False
    while i < n:
        j = int(np.searchsorted(total, total[i] + most - used, side="right")) - 1
        if j > i:  # nodes i..j-1 fit whole
            for k in range(i, j):
                yield chunk, k, 0, int(lengths[k])
            used, filled, i = used + int(total[j] - total[i]), True, j
            continue
        room = most - used - int(costs[i])
        if filled and room <= 0:
            chunk, used, filled = chunk + 1, 0, False
            continue
        at, size = 0, int(lengths[i])
        while at < size:  # split; every cut closes the chunk
            room = most - used - int(costs[i])
            if filled and room <= 0:
                chunk, used, filled = chunk + 1, 0, False
                continue
            take = min(size - at, max(1, room))
            yield chunk, i, at, at + take
            at += take
            used, filled = used + take + int(costs[i]), True
            if at < size:
                chunk, used, filled = chunk + 1, 0, False
        i += 1


def chunk_nodes(nodes: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, chunk_index, piece_ord, node_id, text: greedy packing, a piece costs its text, its id and 2.

    Only lengths pass through Python, one row per document; texts are cut afterwards in the JVM.
    """
    if not 1_000 <= max_chars <= 24_000:
        raise ValueError("max_chars must be within 1000 and 24000")
    full = nodes.filter("text is not null and text <> ''")
    docs = full.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.length("text").alias("n"), (F.length("node_id") + 2).alias("c")))).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, pos, n, c in zip(b["doc_id"], b["pos"], b["n"], b["c"], strict=True):
                last, k = -1, 0
                for chunk, i, a, z in _pieces(np.asarray(n, dtype=np.int64), np.asarray(c, dtype=np.int64), max_chars):
                    k = k + 1 if chunk == last else 0
                    last = chunk
                    rows.append((doc, chunk, k, int(pos[i]), a, z))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "piece_ord", "pos", "a", "z"])

    id_type = nodes.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "x.pos", "x.n", "x.c").mapInPandas(run, f"doc_id {id_type}, chunk_index int, piece_ord int, pos long, a int, z int")
    return cut.join(full.select("doc_id", "pos", "node_id", "text"), ["doc_id", "pos"]).select("doc_id", "chunk_index", "piece_ord", "node_id", F.expr("substring(text, a + 1, z - a)").alias("text"))


def chunk_zip(pairs: DataFrame, tender_chunks: DataFrame, bid_chunks: DataFrame, most: int = MAX_REQUESTS) -> DataFrame:
    """pair_id, chunk_index and whether each side has one; `over_budget` beyond `most` chunks (JN21)."""
    t = pairs.select("pair_id", F.col("tender_id").alias("doc_id")).join(tender_chunks.select("doc_id", "chunk_index").distinct(), "doc_id").select("pair_id", "chunk_index", F.lit(True).alias("has_tender"))
    b = pairs.select("pair_id", F.col("bid_id").alias("doc_id")).join(bid_chunks.select("doc_id", "chunk_index").distinct(), "doc_id").select("pair_id", "chunk_index", F.lit(True).alias("has_bid"))
    d = t.join(b, ["pair_id", "chunk_index"], "full")
    over = F.max("chunk_index").over(Window.partitionBy("pair_id")) + 1 > most
    return d.select("pair_id", "chunk_index", F.coalesce("has_tender", F.lit(False)).alias("has_tender"), F.coalesce("has_bid", F.lit(False)).alias("has_bid"), over.alias("over_budget"))


def review_prompt(pairs: DataFrame, tender_chunks: DataFrame, bid_chunks: DataFrame, most: int = MAX_PROMPT) -> DataFrame:
    """Text of each request: chunk number, tender pieces, bid pieces; `rejected` if too long."""

    def side(col: str, chunks: DataFrame, name: str) -> DataFrame:
        line = F.concat(F.lit("["), "node_id", F.lit("] "), "text")
        rows = ordered_fold(chunks, ["doc_id", "chunk_index"], ["piece_ord"], line, name, separator="\n").drop("n", "used")
        return pairs.select("pair_id", F.col(col).alias("doc_id")).join(rows, "doc_id").drop("doc_id")

    d = side("tender_id", tender_chunks, "t").join(side("bid_id", bid_chunks, "b"), ["pair_id", "chunk_index"], "full")
    text = F.concat(F.lit("chunk "), F.col("chunk_index") + 1, F.lit("\ntender:\n"), F.coalesce("t", F.lit("")), F.lit("\nbid:\n"), F.coalesce("b", F.lit("")))
    return d.withColumn("prompt", text).select("pair_id", "chunk_index", "prompt", (F.length("prompt") > most).alias("rejected"))


def prompt_budget(sections: DataFrame, budget: int, least: int = 200) -> DataFrame:
    """Sections in order until the budget is used up; the last is cut; nothing once fewer than `least` characters are left."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    d = sections.withColumn("left", F.lit(budget) - F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    d = d.withColumn("fail", (F.col("left") < least).cast("int"))
    stop = F.max("fail").over(Window.partitionBy("doc_id").orderBy("ord"))
    return d.withColumn("_stop", stop).filter("_stop = 0").withColumn("text", F.expr("substring(text, 1, left)")).drop("left", "fail", "_stop")
