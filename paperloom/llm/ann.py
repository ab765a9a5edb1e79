"""Approximate nearest neighbours by multi-index hashing (operator 2).

Vectors get binary codes: signs after a rotation learned by iterative quantisation. A code is
split into substrings, and every substring has an index of its own. If two codes are within a
Hamming radius R, one of their m substrings is within R // m (pigeonhole), so probing each
index with that smaller radius retrieves every code within R. What is retrieved is
reranked with the original vectors in double precision.

Equal vectors are folded onto one row first: it stands for its `keep` smallest ids, which is
all that any result list can use, so thousands of copies of one vector cost one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sample_ids, stage

BITS, SUBSTRINGS = 64, 4
SUB_BITS = BITS // SUBSTRINGS
#: Index rows and queries in one group at most (about).
CHUNK, QUERY_BLOCK = 60_000, 4_000
MAX_PREFIX = 12


@dataclass
class Codes:
    """Rotation and radius; a few dozen kB, shipped in closures."""

    mean: np.ndarray
    rotation: np.ndarray  # (d + 1, BITS)
    norm: float  # largest norm: inner products become angles with one more coordinate
    radius: int = BITS

    def _bits(self, x: np.ndarray) -> np.ndarray:
        b = ((x - self.mean) @ self.rotation > 0).astype(np.uint64)
        return (b << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))])

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._bits(self.points(x))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return self._bits(np.column_stack([q, np.zeros(len(q))]))


def learn_codes(x: np.ndarray, norm: float, k: int, *, iterations: int = 25, share: float = 0.97, queries: int = 300, seed: int = 1) -> Codes:
    """Iterative quantisation on a sample; the radius is the smallest that holds `share` of the sample queries' k nearest."""
    rng = np.random.default_rng(seed)
    codes = Codes(np.zeros(x.shape[1] + 1), np.zeros((x.shape[1] + 1, BITS)), norm)
    p = codes.points(x)
    codes.mean = p.mean(axis=0)
    z = p - codes.mean
    _, _, axes = np.linalg.svd(z.T @ z + 1e-9 * np.eye(z.shape[1]))
    blocks, width = [], 0
    while width < BITS:  # vectors shorter than a code get several rotations
        d = min(z.shape[1], BITS)
        base = axes[:d].T
        y = z @ base
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(iterations):
            u, _, vt = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ vt).T
        blocks.append(base @ r)
        width += d
    codes.rotation = np.column_stack(blocks)[:, :BITS]
    rows = codes.of_rows(x)
    pick = rng.permutation(len(x))[:queries]
    asked = codes.of_queries(x[pick])
    far = []
    for i, row in enumerate(pick):
        s = x @ x[row]
        s[row] = -np.inf
        near = np.argpartition(-s, min(k, len(s) - 1))[:k]
        far.append(np.bitwise_count(rows[near[near != row]] ^ asked[i]))
    if far:
        codes.radius = int(np.quantile(np.concatenate(far), share)) if sum(map(len, far)) else BITS
    return codes


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x (array of doubles): rows with an id and a vector that is finite, without nulls, not zero."""
    x = F.col(vector_col).cast("array<double>")
    d = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return d.filter(~bad & F.exists("x", lambda v: v != 0))


def fold_equal(v: DataFrame, keep: int, salts: int = 64) -> DataFrame:
    """One row per distinct vector: rep (smallest id), x, ids (the `keep` smallest, ascending).

    Lists are cut per salt before they meet, so no list gathers a whole group of equal vectors.
    """
    part = v.groupBy("x", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).alias("s")).agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, keep).alias("ids"))
    ids = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, keep)
    return part.groupBy("x").agg(ids.alias("ids")).select(F.col("ids")[0].alias("rep"), "x", "ids")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _substring(code: np.ndarray, j: int) -> np.ndarray:
    return ((code >> np.uint64(j * SUB_BITS)) & np.uint64((1 << SUB_BITS) - 1)).astype(np.uint16)


def _search_group(index: pd.DataFrame, queries: pd.DataFrame, j: int, radius: int, keep: int) -> pd.DataFrame:
    """Probe one substring index with one block of queries."""
    empty = pd.DataFrame({"query": [], "rep": [], "score": []})
    if not len(index) or not len(queries):
        return empty
    near = radius // SUBSTRINGS
    x, codes, reps = _matrix(index["x"]), index["code"].to_numpy(dtype=np.int64).view(np.uint64), index["rep"].to_numpy()
    qx, qcodes, qids = _matrix(queries["x"]), queries["code"].to_numpy(dtype=np.int64).view(np.uint64), queries["rep"].to_numpy()
    order = np.argsort(_substring(codes, j), kind="stable")
    x, codes, reps = x[order], codes[order], reps[order]
    values, first = np.unique(_substring(codes, j), return_index=True)
    ends = np.r_[first[1:], len(codes)]
    out = []
    for i in range(len(qids)):
        hit = np.bitwise_count(values ^ _substring(qcodes[i : i + 1], j)) <= near
        rows = np.flatnonzero(np.repeat(hit, ends - first))
        diff = codes[rows] ^ qcodes[i]
        ok = np.bitwise_count(diff) <= radius
        for earlier in range(j):  # found in an earlier index already
            ok &= np.bitwise_count(_substring(diff, earlier)) > near
        rows = rows[ok]
        if not len(rows):
            continue
        s = x[rows] @ qx[i]
        if len(s) > keep:
            cut = np.partition(s, len(s) - keep)[len(s) - keep]
            best = np.flatnonzero(s >= cut)
            best = best[np.lexsort((reps[rows[best]], -s[best]))][:keep]
        else:
            best = np.arange(len(s))
        out.append(pd.DataFrame({"query": qids[i], "rep": reps[rows[best]], "score": s[best]}))
    return pd.concat(out, ignore_index=True) if out else empty


def _probe(index: DataFrame, queries: DataFrame, codes: Codes, radius: int, keep: int, n_index: int, n_queries: int) -> DataFrame:
    """query, rep, score: the `keep` best of each query within the Hamming radius."""
    spark = index.sparkSession
    bits = min(MAX_PREFIX, max(0, int(np.ceil(np.log2(max(1, n_index / CHUNK))))))
    shift = SUB_BITS - bits
    near = radius // SUBSTRINGS

    def coded(of):
        @F.pandas_udf("long")
        def code(x: pd.Series) -> pd.Series:
            return pd.Series(of(_matrix(x)).view(np.int64) if len(x) else np.zeros(0, dtype=np.int64))

        return code

    def sub(j: Column) -> Column:
        return F.expr(f"cast(shiftrightunsigned(code, j * {SUB_BITS}) & {(1 << SUB_BITS) - 1} as int)")

    each = F.explode(F.sequence(F.lit(0), F.lit(SUBSTRINGS - 1)))
    rows = stage(index.select("rep", "x", coded(codes.of_rows)("x").alias("code")), "codes").withColumn("j", each)
    rows = rows.withColumn("prefix", F.shiftright(sub(F.col("j")), shift))
    # groups of one prefix are cut into chunks by their counts (SUBSTRINGS * 2**MAX_PREFIX rows at most)
    chunks = rows.groupBy("j", "prefix").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    chunks = stage(chunks, "chunks")
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    rows = rows.join(F.broadcast(chunks), ["j", "prefix"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = stage(queries.select("rep", "x", coded(codes.of_queries)("x").alias("code")), "asked").withColumn("j", each)
    asked = asked.withColumn("own", F.shiftright(sub(F.col("j")), shift)).withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    # the prefixes a probe can reach: those that differ from its own in at most `near` bits
    asked = asked.join(F.broadcast(chunks), "j").filter(F.bit_count(F.col("own").bitwiseXOR(F.col("prefix"))) <= near)
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["j", "prefix", "chunk", "block"]
    cols = [*keys, "rep", "x", "code"]

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _search_group(left, right, int(key[0]), radius, keep)

    found = rows.select(*cols).groupBy(*keys).cogroup(asked.select(*cols).groupBy(*keys)).applyInPandas(search, "query long, rep long, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    return stage(found.withColumn("r", best).filter(F.col("r") <= keep).drop("r"), "found")


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, max_sample: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query, ties to the smaller id.

    `is_query` is a condition on `vec_id`. Codes are learned on at most `max_sample` vectors;
    every vector is indexed. Null, zero or non-finite vectors, vectors with null parts and rows
    without an id take no part; equal (id, vector) rows count once. Vectors of different lengths have no inner
    product: each length has an index of its own and is searched by the queries of that length. A query for
    which the radius holds fewer than k others is searched again without one.
    """
    v = stage(valid_vectors(vectors, id_col, vector_col).distinct(), "vectors")
    sizes = sorted(r["d"] for r in v.select(F.size("x").alias("d")).distinct().collect())  # one row per length
    found = [_search_length(v if len(sizes) == 1 else v.filter(F.size("x") == d), is_query, k, max_sample) for d in sizes]
    return reduce(DataFrame.union, found) if found else v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search_length(v: DataFrame, is_query: Column, k: int, max_sample: int) -> DataFrame:
    """The search among staged vectors of one length."""
    keep = k + 1
    reps = stage(fold_equal(v, keep), "reps")
    n = reps.count()
    members = v.filter(is_query).join(reps.select("rep", "x"), "x").select("vec_id", F.col("rep").alias("query"))
    members = stage(members, "members")
    asked = reps.join(members.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select("rep", "x")
    norm = v.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y * y)))).first()[0]
    sample = _matrix(sample_ids(reps.select("rep", "x"), "rep", max_sample).toPandas()["x"])
    codes = learn_codes(sample, float(norm), keep)
    n_asked = asked.count()
    found = _probe(reps.select("rep", "x"), asked, codes, codes.radius, keep, n, n_asked)
    enough = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(keep, n)).select(F.col("query").alias("rep"))
    short = stage(asked.join(enough, "rep", "left_anti"), "short")
    n_short = short.count()
    if n_short and codes.radius < BITS:
        again = _probe(reps.select("rep", "x"), short, codes, BITS, keep, n, n_short)
        found = found.join(short.select(F.col("rep").alias("query")), "query", "left_anti").union(again)
    ids = found.join(reps.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("near"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    ids = ids.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep)
    out = members.withColumnRenamed("vec_id", "query_id").join(ids, "query").filter(F.col("near") != F.col("query_id"))
    # a query's own place in its list closes up
    own = members.withColumnRenamed("vec_id", "query_id").join(ids.select("query", F.col("near").alias("query_id"), F.col("r").alias("own")), ["query", "query_id"])
    out = out.join(own.select("query_id", "own"), "query_id", "left").withColumn("rank", (F.col("r") - F.when(F.col("r") > F.col("own"), 1).otherwise(0)).cast("int"))
    return out.filter(F.col("rank") <= k).select("query_id", "rank", F.col("near").alias("vec_id"), "score")
