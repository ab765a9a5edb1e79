"""Balanced label propagation (operator 5).

Documents with equal texts are linked. Documents start in shards by hash; in every round
each group agrees on the shard that holds most of it, and documents move there as far as quotas
between each two shards allow: whole groups in a fixed order, those with the most documents at their goal first
(each move there joins the most links), and of the one that crosses the quota as many as are left. All documents of one group in one shard are alike, so a round works on counts per
(group, shard): a group of any size is eight rows. A move never goes to a smaller cell, so the sum of the
squared counts grows with each round, and rounds end when no move is left. At the end surplus
rows, unlinked ones first, move so that the counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, gapless_rank, join_spread, stage


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, link (128-bit text hash). Null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.unhex(F.md5(text)).alias("link"))


def quotas(wish: dict[tuple[int, int], int], load: list[int], cap: int) -> dict[tuple[int, int], float]:
    """Share of each wished flow that may move, so that no shard ends over `cap`."""
    share = dict.fromkeys(wish, 1.0)
    for _ in range(50):
        over = False
        for t in range(len(load)):
            came = sum(share[k] * n for k, n in wish.items() if k[1] == t)
            went = sum(share[k] * n for k, n in wish.items() if k[0] == t)
            room = max(0.0, cap - load[t] + went)
            if came > room + 1e-6:
                over = True
                for k in wish:
                    if k[1] == t:
                        share[k] *= room / came
        if not over:
            break
    return share


def whole_quotas(wish: dict[tuple[int, int], int], load: list[int], cap: int) -> dict[tuple[int, int], int]:
    """`quotas` as rows: what the flows into a shard lose by rounding down goes to those that lose the most."""
    share = quotas(wish, load, cap)
    exact = {k: share[k] * n for k, n in wish.items()}
    out = {k: int(x + 1e-9) for k, x in exact.items()}
    for t in range(len(load)):
        into = sorted((k for k in wish if k[1] == t), key=lambda k: (out[k] - exact[k], k))
        spare = int(sum(exact[k] for k in into) + 1e-6) - sum(out[k] for k in into)
        for k in into[: max(0, spare)]:
            out[k] += out[k] < wish[k]
    return out


def moves_within(moving: DataFrame, quota: dict[tuple[int, int], int], n_cells: int) -> DataFrame:
    """link, shard, to, m > 0: what of `moving(link, shard, to, n, gain)` moves, at most `quota` rows from each shard to each other.

    The cells of a flow come by falling gain, then by hashes of links; their running sum is taken within parts of
    both and over the parts, of which there are more the more cells there are.
    """
    buckets = max(64, -(-n_cells // BUCKET_ROWS))
    b = moving.withColumn("bucket", F.pmod(F.xxhash64("link"), F.lit(buckets)))
    flow = ["shard", "to"]
    earlier = Window.unboundedPreceding, -1
    part = ["gain", "bucket"]
    sums = b.groupBy(*flow, *part).agg(F.sum("n").alias("s"))
    sums = sums.select(*flow, *part, F.coalesce(F.sum("s").over(Window.partitionBy(*flow).orderBy(F.desc("gain"), "bucket").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    local = F.coalesce(F.sum("n").over(Window.partitionBy(*flow, *part).orderBy("link").rowsBetween(*earlier)), F.lit(0))
    limits = F.broadcast(moving.sparkSession.createDataFrame([(*k, q) for k, q in quota.items()], "shard int, to int, quota long"))  # shards squared at most
    m = F.least("n", F.col("quota") - F.col("before") - F.col("local"))
    return b.withColumn("local", local).join(sums, [*flow, *part]).join(limits, flow).select("link", "shard", "to", m.alias("m")).filter("m > 0")


def propagate(cells: DataFrame, singles: list[int], shards: int, *, slack: float = 0.1) -> DataFrame:
    """Rounds of moves over `cells(link, shard, n)` until none is left; `singles` are the unlinked rows per shard, which stay."""
    while True:
        load = list(singles)
        for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row per shard
            load[r["shard"]] += r["n"]
        cap = int(sum(load) / shards * (1 + slack)) + 8  # evened out at the end, with unlinked rows where there are any
        # a full shard is nobody's goal: what a group cannot bring there gathers in its next largest one
        open_shards = [s for s in range(shards) if load[s] * 100 < cap * 99]
        rank = F.struct("n", F.xxhash64("link", "shard").alias("tie"), "shard")
        goal = cells.filter(F.col("shard").isin(open_shards)).groupBy("link").agg(F.max(rank).alias("best"))
        moving = stage(cells.join(goal, "link").filter(rank < F.col("best")).select("link", "shard", F.col("best.shard").alias("to"), "n", F.length(F.bin("best.n")).alias("gain")), "moving")
        wish, n_cells = {}, 0
        for r in moving.groupBy("shard", "to").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells")).collect():  # shards squared at most
            wish[r["shard"], r["to"]] = r["n"]
            n_cells += r["cells"]
        quota = whole_quotas(wish, load, cap)
        if not any(quota.values()):
            return cells
        moved = moves_within(moving, quota, n_cells)
        delta = moved.select("link", "shard", (-F.col("m")).alias("n"), F.col("to"), F.col("m"))
        delta = delta.select("link", F.explode(F.array(F.struct("shard", "n"), F.struct(F.col("to").alias("shard"), F.col("m").alias("n")))).alias("c")).select("link", "c.shard", "c.n")
        cells = stage(cells.select("link", "shard", "n").union(delta).groupBy("link", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "cells")


def transfers(load: list[int]) -> list[tuple[int, int, int, int]]:
    """(from, lo, hi, to): ranks lo..hi-1 of a shard that go elsewhere, so that loads end at most one apart."""
    n, k = sum(load), len(load)
    order = sorted(range(k), key=lambda s: -load[s])
    want = [0] * k
    for i, s in enumerate(order):
        want[s] = n // k + (i < n % k)
    need = [[s, want[s] - load[s]] for s in range(k) if want[s] > load[s]]
    out = []
    for s in range(k):
        at, extra = 0, load[s] - want[s]
        while extra > 0:
            t, room = need[0]
            m = min(room, extra)
            out.append((s, at, at + m, t))
            at, extra = at + m, extra - m
            need[0][1] -= m
            if not need[0][1]:
                need.pop(0)
    return out


def shard_documents(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, link, shard, slot for every row; counts per shard at most one apart.

    Null texts are linked with empty ones; null or repeated ids are rows like others. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = stage(measured(docs, id_col, text_col), "measured")
    start = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(shards)).cast("int")
    group = stage(base.groupBy("link").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("linked", F.lit(1)), "groups")
    rows = join_spread(base.withColumn("shard", start), group, "link", "n", ["doc_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    rows = stage(rows, "rows")
    singles = [0] * shards
    for r in rows.filter("linked = 0").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per shard
        singles[r["shard"]] = r["n"]
    cells = stage(rows.filter("linked = 1").groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n")), "cells")
    cells = propagate(cells, singles, shards)
    # hand the cells' counts out to documents: ranks within the group, in ranges
    ranges = cells.groupBy("link").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("c"), F.sum("n").alias("n"))  # at most `shards` entries
    ends = F.transform("c", lambda x, i: F.struct(F.aggregate(F.slice(F.col("c"), 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("end"), x["shard"].alias("shard")))
    linked = gapless_rank(rows.filter("linked = 1").drop("shard"), ["link"], [], ["doc_id"], "k", 64)
    linked = join_spread(linked, stage(ranges.select("link", ends.alias("ends"), "n"), "ranges"), "link", "n", ["doc_id"]).withColumn("shard", F.element_at(F.filter("ends", lambda e: F.col("k") < e["end"]), 1)["shard"])
    cols = ["doc_id", "size", "text_crc32", "link", "linked", "shard"]
    placed = stage(rows.filter("linked = 0").select(*cols).union(linked.select(*cols)), "placed")
    load = [0] * shards
    for r in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
        load[r["shard"]] = r["n"]
    ranked = gapless_rank(placed, ["shard"], ["linked"], ["doc_id", "link"], "k")
    moves = F.broadcast(spark.createDataFrame(transfers(load), "s int, lo long, hi long, t int"))  # shards squared at most
    even = ranked.join(moves, (F.col("shard") == F.col("s")) & (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")), "left").withColumn("shard", F.coalesce("t", "shard"))
    even = stage(even.select("doc_id", "size", "text_crc32", "link", "shard"), "even")
    return gapless_rank(even, ["shard"], [], ["doc_id", "link"], "slot").select("doc_id", "size", "text_crc32", "link", "shard", "slot")
