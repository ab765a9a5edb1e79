"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(e: DataFrame, larger_only: bool) -> DataFrame:
    """Points each node's neighbours (and itself) at the smallest of them.

    The minimum is an aggregate with map-side combine and the join splits under AQE, so a node
    with very many neighbours is not gathered anywhere.
    """
    if larger_only:  # small star: the node with its smaller neighbours
        sided = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        sided = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = sided.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    hit = sided.join(low, "a")
    if larger_only:
        out = hit.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    else:
        out = hit.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """`links(a, b)` to `(node, component)`: the smallest node reachable, for every node in a link.

    Rounds of large star and small star until the edges stop changing; every round is written to
    the shared folder. Self links and null ends are ignored.
    """
    e = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct(), "links")
    before = None
    while True:
        e = stage(_star(_star(e, False), True), "stars")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
