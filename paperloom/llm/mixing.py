"""Temperature mixing of sources (operator 10).

Source i with token share p_i gets the weight p_i**a / sum_j p_j**a. The exponent a is found by
sectioning an interval until the repetition limit or the target entropy is met. Weights become
budgets; a budget is realised as permutations of blocks: whole epochs of a source's blocks, each
in its own order, and the first blocks of one more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SEP, stage

#: Blocks per source. A block is the rows of one hash value, so that a window over the blocks of a source has this many rows at most.
BLOCKS = 256
#: Up to so many rows (a few MB) the block plan is broadcast; beyond that it is joined by shuffle.
PLAN_ROWS = 100_000


def word_tokens(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    t = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WORD_SEP + "+", -1))).cast("long")


def source_totals(docs: DataFrame, source: Column, tokens: Column) -> DataFrame:
    """source, tokens, docs, share. A null source is a source of its own."""
    t = docs.select(source.alias("source"), tokens.alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = t.agg(F.sum("tokens")).first()[0] or 1
    return t.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(total))


def find_exponent(totals: DataFrame, *, max_repeats: float | None = 2.0, target_entropy: float | None = None, steps: int = 6, sections: int = 16) -> float:
    """The exponent in 0..1, found to sections**-steps.

    With `target_entropy` (share of the highest possible, 0..1): the largest exponent whose weights
    reach it. Otherwise the smallest exponent (flattest weights) under which no source is repeated
    more than `max_repeats` times when the least repeated one is read once. Each step is one
    aggregate over the sources for all its trial exponents; nothing but its few sums is collected.
    """
    p = totals.agg(F.count(F.lit(1)).alias("k"), F.min("share").alias("lo"), F.max("share").alias("hi")).first()
    if not p["k"] or p["lo"] == p["hi"]:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        trial = [lo + (hi - lo) * i / sections for i in range(sections + 1)]
        a = F.col("a")
        w = F.pow("share", a)
        grid = totals.withColumn("a", F.explode(F.array(*map(F.lit, trial))))
        sums = grid.groupBy("a").agg(F.sum(w).alias("s"), F.sum(w * a * F.log("share")).alias("e"), F.max(F.pow("share", a - 1)).alias("most"), F.min(F.pow("share", a - 1)).alias("least"))
        ok = {}
        for r in sums.collect():
            if target_entropy is not None:
                entropy = math.log(r["s"]) - r["e"] / r["s"]
                ok[r["a"]] = entropy < target_entropy * math.log(p["k"]) - 1e-12
            else:
                ok[r["a"]] = r["most"] / r["least"] <= max_repeats * (1 + 1e-12)
        good = [x for x in trial if ok[x]]
        bad = [x for x in trial if not ok[x]]
        # ok holds from some exponent upwards in both cases
        if not good:
            return 1.0
        if not bad:
            return lo
        lo, hi = max(bad), min(good)
    return lo if target_entropy is not None else hi


def budgets(totals: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """Adds weight, quota (tokens) and epochs. Without a budget the least repeated source is read exactly once."""
    w = F.pow("share", F.lit(exponent))
    t = totals.withColumn("weight", w / F.lit(totals.agg(F.sum(w)).first()[0] or 1.0))
    whole = t.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0 if budget is None else float(budget)
    return t.withColumn("quota", F.col("weight") * F.lit(whole)).withColumn("epochs", F.col("quota") / F.col("tokens"))


def block_plan(blocks: DataFrame, quotas: DataFrame, seed: int = 0) -> DataFrame:
    """source, block, epoch, mix_order: which blocks are read, and where in the mixture (0..1).

    `blocks(source, block, tokens)`. Within an epoch the blocks of a source come in the order of a seeded
    hash of source, block and epoch, so each source has its own order; the last epoch ends where its quota does, to half a block.
    """
    q = quotas.select(F.col("source").alias("of"), "quota", "epochs", F.col("tokens").alias("total"))
    b = blocks.join(q, F.col("source").eqNullSafe(F.col("of")))
    b = b.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("epochs").cast("int") - 1))))
    order = F.xxhash64("source", "block", "epoch", F.lit(seed))
    w = Window.partitionBy("source", "epoch").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("epoch") * F.col("total") + F.coalesce(F.sum("tokens").over(w), F.lit(0)) + F.col("tokens") / 2
    return b.withColumn("at", at).filter((F.col("at") <= F.col("quota") * (1 + 1e-9)) | (F.col("tokens") == 0) & (F.col("epoch") == 0)).select("source", "block", "epoch", (F.col("at") / F.col("quota")).alias("mix_order"))


ADDED = ["n_tokens", "epoch", "block", "mix_order"]


def _placed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """row (the user's columns as they are) and the `ADDED` columns of every place in the mixture."""
    block = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(blocks)).cast("int")
    keyed = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), word_tokens(F.col(text_col)).alias("n_tokens"), block.alias("block"))
    per_block = stage(keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "blocks")
    totals = stage(source_totals(per_block, F.col("source"), F.col("tokens")), "totals")
    quotas = budgets(totals, find_exponent(totals, max_repeats=max_repeats, target_entropy=target_entropy), budget)
    plan = block_plan(per_block.select("source", "block", "tokens"), quotas, seed)
    empty = per_block.join(totals, per_block["source"].eqNullSafe(totals["source"]), "left_anti").select("source", "block", F.lit(0).alias("epoch"), F.lit(0.0).alias("mix_order"))
    plan = stage(plan.union(empty), "plan").select(F.col("source").alias("of"), F.col("block").alias("of_block"), "epoch", "mix_order")
    if plan.count() <= PLAN_ROWS:
        plan = F.broadcast(plan)
    return keyed.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))).select("row", *ADDED)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mixture: all columns of `docs` plus n_tokens, epoch, block, mix_order, which win over columns of these names.

    Sorting by mix_order reads the sources in their target proportions throughout. The rows of a block share its place, as may
    blocks of several sources; sort by mix_order, source, block, epoch and the id for one defined order. Without a
    `budget` every row is read at least once. Rows of sources without any word are read once
    (epoch 0, mix_order 0). Null sources mix as one source; rows with equal or null ids share a block.
    Options: id_col, source_col, text_col, max_repeats, target_entropy, budget, blocks, seed.
    """
    return _placed(docs.drop(*ADDED), **options).select("row.*", *ADDED)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of `docs` only, whatever their names; a document read in several epochs appears once for each."""
    return _placed(docs, **options).select("row.*")
