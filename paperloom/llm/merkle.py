"""Merkle manifest of a dataset (operator 11): a tree of SHA-256 midstates.

Each row is a leaf; three consecutive nodes have one parent. A parent keeps a copy of its hash
state before each of its children, so a changed child is folded by resuming the state of its slot
with the new digest and the siblings to its right; what stands to its left is never hashed again.

Hash states cannot leave the process that made them. So a task gets a block of `3 ** levels`
consecutive nodes with the siblings above the block, rebuilds the states of the block once and
folds all its nodes with them. Blocks of blocks are made the same way until a group has one node:
no task ever holds a whole group, and the number of rounds grows with the logarithm of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stage

#: Children of a node.
FANOUT = 3
#: Levels that one task folds at once: a block has at most 729 nodes.
LEVELS = 6
#: Rows that one range sorts about.
RANGE_ROWS = 1_000_000
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_PATH = "array<struct<before:array<string>,after:array<string>>>"


def leaf_hash(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values as text: UTF-8 byte count, `:`, value; `-` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ordered_index(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx (from 0 without gaps within `g`, by `order`, nulls first) and n, the rows of `g`.

    Rows are dealt by ranges of (g, order), so a group of any size spreads over the tasks; only
    the row counts of each range are summed in order. `df` must be staged: ranges are sampled from it.
    """
    # row numbers of a sorted range are the low 33 bits of the increasing id, the range the bits above
    number = max(parts(df.sparkSession), -(-df.count() // RANGE_ROWS))
    ranges = df.repartitionByRange(number, "g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id())
    ranges = stage(ranges.withColumn("part", F.shiftright("at", 33)), "ranges")
    counts = ranges.groupBy("g", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    of_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(of_group).alias("n"))
    return ranges.join(counts, ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def levels_above(n: int) -> int:
    """How often runs of three are hashed until one of `n` nodes remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


class Block:
    """Consecutive nodes of one group with all parents up to the block's top."""

    def __init__(self, digests: list[bytes], levels: int):
        self.levels = []
        for _ in range(levels):
            parents = [digests[i : i + FANOUT] for i in range(0, len(digests), FANOUT)]
            self.levels.append([(_states(p), p) for p in parents])
            digests = [resume(s[-1], p[-1:]) for s, p in self.levels[-1]]
        (self.top,) = digests

    def path(self, at: int) -> Iterator[tuple[object, list[bytes], list[bytes]]]:
        """Level by level for node `at`: the state before its slot, siblings before and after."""
        for level in self.levels:
            at, slot = divmod(at, FANOUT)
            states, children = level[at]
            yield states[slot], children[:slot], children[slot + 1 :]


def _states(children: list[bytes]) -> list:
    """Copies of the parent's hash state before each child."""
    h, out = sha256(), []
    for c in children:
        out.append(h.copy())
        h.update(c)
    return out


def resume(state, digests: list[bytes]) -> bytes:
    h = state.copy()
    for d in digests:
        h.update(d)
    return h.hexdigest().encode()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after another; rows arrive sorted by block."""

    def rows() -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    for _, block in groupby(rows(), key=itemgetter("g", "block")):
        yield list(block)


def _dealt(nodes: DataFrame, levels: int, above: DataFrame | None = None) -> DataFrame:
    """Nodes of one block side by side in one task, after the row of `above` for that block."""
    out = nodes.withColumn("block", F.expr(f"idx div {FANOUT**levels}"))
    if above is not None:
        out = out.unionByName(above.withColumnRenamed("idx", "block").withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
    return out.repartition("g", "block").sortWithinPartitions("g", "block", "idx")


def _block(rows: list[dict], levels: int) -> Block:
    return Block([r["digest"].encode() for r in rows], min(levels, levels_above(rows[0]["n"])))


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """`g, idx, n, digest` of the blocks' tops: the nodes `levels` levels further up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            top = _block(rows, levels).top.decode()
            yield _batch({"g": ([rows[0]["g"]], pa.string()), "idx": ([rows[0]["block"]], pa.int64()), "n": ([-(-rows[0]["n"] // FANOUT**levels)], pa.int64()), "digest": ([top], pa.string())})

    return _dealt(nodes.select("g", "idx", "n", "digest"), levels).mapInArrow(run, "g string, idx long, n long, digest string")


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """`nodes` and the tops of its blocks, of their blocks and so on, until each group has one node."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    out = [nodes]
    while len(out) == 1 or most > 1:
        out.append(stage(_tops(out[-1], levels), "tops"))
        most = -(-most // FANOUT**levels)
    return out


def _paths(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """`g, idx, path, subroot, root` of the nodes: `above` has the same of the tops of their blocks."""
    path_type = pa.list_(pa.struct([("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (up, *rows) in _blocks(batches):
            block, text = _block(rows, levels), lambda x: [d.decode() for d in x]
            paths = [[{"before": text(b), "after": text(a)} for _, b, a in block.path(i)] + up["path"] for i in range(len(rows))]
            yield _batch({
                "g": ([r["g"] for r in rows], pa.string()), "idx": ([r["idx"] for r in rows], pa.int64()), "path": (paths, path_type),
                "subroot": ([up["subroot"]] * len(rows), pa.string()), "root": ([up["root"]] * len(rows), pa.string()),
            })

    return _dealt(nodes.select("g", "idx", "n", "digest"), levels, above).mapInArrow(run, f"g string, idx long, path {_PATH}, subroot string, root string")


def _fold(leaves: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Folds every leaf (its changed digest, where it has one) up to the root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (up, *rows) in _blocks(batches):
            block = _block(rows, levels)
            higher = []
            for level in up["path"]:
                before, after = ([d.encode() for d in level[k]] for k in ("before", "after"))
                h = sha256()
                for d in before:
                    h.update(d)
                higher.append((h, before, after))
            folded, proofs = [], []
            for i, r in enumerate(rows):
                digest, proof = (r["changed"] or r["digest"]).encode(), sha256()
                for state, before, after in (*block.path(i), *higher):
                    for d in before:
                        proof.update(d)
                    for d in after:
                        proof.update(d)
                    digest = resume(state, [digest, *after])
                folded.append(digest.decode())
                proofs.append(proof.hexdigest())
            yield _batch({
                "doc_id": ([r["doc_id"] for r in rows], pa.int64()), "source": ([r["g"][1:] if r["g"] else None for r in rows], pa.string()), "leaf": ([r["digest"] for r in rows], pa.string()),
                "subroot": ([up["subroot"]] * len(rows), pa.string()), "root": ([up["root"]] * len(rows), pa.string()), "proof_sha256": (proofs, pa.string()),
                "folded_root": (folded, pa.string()), "verified": ([f == up["root"] for f in folded], pa.bool_()),
            })

    ddl = "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _dealt(leaves, levels, above).mapInArrow(run, ddl)


def manifest(docs: DataFrame, *, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of `docs`: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a group stand in the order of `id_col` (null first; equal ids by leaf, so equal rows may
    change places without effect). Subroots stand in the order of their groups, null first, then
    by UTF-8 bytes. `changed` gives other values for some fields of the rows `where` holds: these rows are
    folded from the leaf of the changed values along the unchanged siblings, so `verified` tells whether the
    change is found. `proof_sha256` is the hash of all siblings on a leaf's way. An empty table gives no row; other columns are ignored.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    other = leaf_hash([(changed or {}).get(c, v) for c, v in values.items()])
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        # "" sorts before all others, and the mark keeps the order of bytes
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("g"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        leaf_hash(list(values.values())).alias("digest"),
        F.when(F.lit(False) if where is None else where, other).alias("changed"),
        F.monotonically_increasing_id().alias("tie"),  # spreads rows that are equal in everything
    )
    leaves = stage(ordered_index(stage(leaves, "leaves"), ["doc_id", "digest", "tie"]).drop("tie"), "leaves")
    rounds = _rounds(leaves, levels)
    subroots = rounds[-1].select(F.lit("").alias("g"), F.col("g").alias("group"), "digest")
    subroots = stage(ordered_index(stage(subroots, "subroots"), ["group"]), "subroots")
    tops = _rounds(subroots, levels)
    above = tops[-1].select("g", "idx", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in tops[-2::-1]:
        above = stage(_paths(nodes, above, levels), "paths")
    above = subroots.join(above, "idx").select(F.col("group").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in rounds[-2:0:-1]:
        above = stage(_paths(nodes, above, levels), "paths")
    return _fold(leaves.select("g", "idx", "n", "digest", "changed", "doc_id"), above, levels)


def op11(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The contract's manifest: rows with an even crc32 of their id (null ids: none) are folded without the line ends of their text."""
    even = F.col("doc_id").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0)
    out = manifest(docs, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}, where=even, levels=levels)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
