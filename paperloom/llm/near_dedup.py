"""MinHash near-duplicate detection with an LSH forest (operator 8).

1. Each document becomes its set of word shingles, as 64-bit hashes; equal sets are folded
   onto their smallest id, so groups of copies cost one row from here on.
2. A forest of `TREES` sorted orders: tree t sorts all sets by its own `DEPTH` minhashes. A
   region is a run with a common prefix. Regions of at most `REGION` sets give all their pairs;
   larger ones are split at deeper prefixes into blocks, and a block gives the pairs that keep
   it connected: a maximum spanning forest over signature agreement, and each row's best
   partners. Depth thus adapts to the density of each region, and a group of
   thousands of near copies gives pairs in proportion to its size.
3. Pairs whose signatures make a similarity over the threshold implausible are
   dropped at once; the rest are confirmed on the full sets.
4. Confirmed links are joined into components.
5. Regions that did not give all their pairs are searched again, wholly: every pair of theirs
   between different components is weighed by its signatures, and the plausible ones are
   confirmed on the full sets. Pairs within a component are linked already, so a group of near
   copies costs little here. Slices of a region meet in bounded groups, and a set is sent once to
   each group it is confirmed in, however many pairs it has there.

At similarity 0.8 a pair shares a depth-4 prefix in at least one of 24 trees with probability 0.999997.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_spread, may_contain, parts, stage
from .components import components

TREES, DEPTH, BASE, REGION, BLOCK, SURE, UNSURE = 24, 6, 4, 12, 512, 2, 12
PERMUTATIONS = TREES * DEPTH
MARGIN = 0.16
#: A slice of a region has about so many sets and so many shingles.
SLICE, SLICE_SHINGLES = 1024, 1_000_000
#: Rows of the sorted orders that a task holds.
TASK_ROWS = 400_000
#: Equal halves of two bytes.
_EQUAL = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], dtype=np.uint8)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    """64-bit hash of a word, remembered for recent words (a few MB)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; shorter texts are one shingle, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * _MIX[k % 64] + h[k : k + len(out)]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minhashes (multiply-shift family) of a non-empty set."""
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048, None]
        np.minimum(out, ((x * _A + _B) >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(">u4")


def halves(sig: np.ndarray) -> np.ndarray:
    """The low four bits of each minhash, two to a byte."""
    low = (sig & 15).astype(np.uint8)
    return low[0::2] | low[1::2] << 4


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set; null without shingles), sig and low (its `halves`)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes, keys, sigs, lows = [], [], [], []
            for t in b["text"]:
                s = shingle_set(t, n)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig = signature(s) if len(s) else None
                sigs.append(sig.tobytes() if len(s) else None)
                lows.append(halves(sig).tobytes() if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_shingles": sizes, "set_key": keys, "sig": sigs, "low": lows})

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInPandas(run, "doc_id long, n_shingles long, set_key binary, sig binary, low binary")


def _common(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (np.cumprod(keys[i] == keys[j], axis=1)).sum(axis=1)


def _agreement(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Estimated similarity of row pairs, in slices of bounded memory."""
    out = np.empty(len(i), dtype=np.float32)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        out[s] = _EQUAL[low[i[s]] ^ low[j[s]]].sum(axis=1, dtype=np.uint8)
    return _similarity(out)


def _similarity(equal: np.ndarray) -> np.ndarray:
    """Similarity estimated from the number of equal four-bit values; a sixteenth of the unequal ones agrees by chance."""
    return (equal / np.float32(PERMUTATIONS) - np.float32(1 / 16)) * np.float32(16 / 15)


def _forest(weight: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest of a dense similarity matrix, by merging best neighbours."""
    n = len(weight)
    label, edges = np.arange(n), []
    w = weight.copy()
    while True:
        w[label[:, None] == label[None, :]] = -1
        best = w.argmax(axis=1)
        value = w[np.arange(n), best]
        order = np.lexsort((-value, label))
        first = order[np.r_[True, label[order][1:] != label[order][:-1]]]
        first = first[value[first] >= least]
        if not len(first):
            return edges
        for x in first:
            p, q = label[x], label[best[x]]
            if p != q:
                edges.append((x, best[x]))
                label[label == max(p, q)] = min(p, q)


def _dense_pairs(low: np.ndarray, least: float, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block of a large region: a maximum spanning forest and each row's best partners;
    more of them where no partner is surely over the threshold."""
    n = len(low)
    w = np.empty((n, n), dtype=np.float32)
    for i in range(n):
        w[i] = _EQUAL[low ^ low[i]].sum(axis=1, dtype=np.uint8)
    w = _similarity(w)
    np.fill_diagonal(w, -1)
    edges = np.array(_forest(w, least), dtype=np.int64).reshape(-1, 2)
    k = min(UNSURE, n - 1)
    top = np.argpartition(-w, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(w, top, axis=1)
    order = np.argsort(-value, axis=1)
    top, value = np.take_along_axis(top, order, axis=1), np.take_along_axis(value, order, axis=1)
    # a partner over the threshold is hardly more than the signatures' noise below the best one
    use = (value >= least) & ((np.arange(k) < SURE) | ((value[:, :1] < sure) & (value >= value[:, :1] - 0.1)))
    i, r = np.nonzero(use)
    return np.r_[edges[:, 0], i], np.r_[edges[:, 1], top[i, r]]


def region_pairs(keys: np.ndarray, low: np.ndarray, least: float, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Plausible pairs (row numbers) of sorted keys, one tree, by regions of adaptive depth.

    A region of at most REGION rows gives all its pairs. A larger one is cut where its common
    prefixes are shortest until its blocks have at most BLOCK rows; neighbouring blocks overlap.
    """
    n = len(keys)
    if n < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lcp = _common(keys, np.arange(n - 1), np.arange(1, n))
    starts = np.flatnonzero(np.r_[True, lcp < BASE])
    sizes = np.diff(np.r_[starts, n])
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for size in range(2, REGION + 1):
        at = starts[sizes == size]
        if len(at):
            a, b = np.triu_indices(size, 1)
            left.append((at[:, None] + a).ravel())
            right.append((at[:, None] + b).ravel())
    i, j = np.concatenate(left), np.concatenate(right)
    ok = _agreement(low, i, j) >= least
    left, right = [i[ok]], [j[ok]]
    todo = [(int(s), int(s + z), BASE) for s, z in zip(starts, sizes, strict=True) if z > REGION]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= BLOCK:
            i, j = _dense_pairs(low[lo:hi], least, sure)
            left.append(i + lo)
            right.append(j + lo)
        elif depth < keys.shape[1]:
            cuts = lo + 1 + np.flatnonzero(lcp[lo : hi - 1] < depth + 1)
            bounds = [lo, *cuts.tolist(), hi]
            todo += [(a, b, depth + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1]
            todo += [(max(lo, c - REGION), min(hi, c + REGION), depth) for c in cuts.tolist()]  # rows on both sides of a cut
        else:
            todo += [(a, min(a + BLOCK, hi), depth) for a in range(lo, hi - 1, BLOCK // 2)]
    return np.concatenate(left), np.concatenate(right)


def _open_starts(keys: np.ndarray) -> np.ndarray:
    """First rows of the regions of one tree that `region_pairs` does not search wholly."""
    starts = np.flatnonzero(np.r_[True, _common(keys, np.arange(len(keys) - 1), np.arange(1, len(keys))) < BASE])
    return starts[np.diff(np.r_[starts, len(keys)]) > REGION]


def _tree_rows(reps: DataFrame) -> DataFrame:
    width = 4 * DEPTH
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    return reps.select("doc_id", trees, "sig", "low").select("doc_id", "tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("key"), "low")


def _matrix(column: pd.Series, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), width)


def candidates(reps: DataFrame, threshold: float, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of the forest over `reps(doc_id, sig, low)`, and the regions not searched wholly.

    Pairs whose estimated similarity is below threshold - margin (4.5 standard deviations) are
    left out. The orders are range-partitioned, so a prefix that very many sets share spreads over
    as many partitions as it needs; regions that touch a cut are among those not searched wholly.
    """
    n = max(parts(reps.sparkSession), -(-reps.count() * TREES // TASK_ROWS))
    least, sure = threshold - margin, threshold + 0.08
    rows = _tree_rows(reps).repartitionByRange(n, "tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        f = pd.concat(frames, ignore_index=True)
        tree, ids = f["tree"].to_numpy(), f["doc_id"].to_numpy()
        keys, low = _matrix(f["key"], ">u4", DEPTH).astype(np.uint32), _matrix(f["low"], "u1", PERMUTATIONS // 2)
        for t in np.unique(tree):
            at = np.flatnonzero(tree == t)
            i, j = region_pairs(keys[at], low[at], least, sure)
            a, b = ids[at[i]], ids[at[j]]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "tree": -1, "key": None}).drop_duplicates()
            yield pd.DataFrame({"a": -1, "b": -1, "tree": t, "key": f["key"].iloc[at[_open_starts(keys[at])]]})
        ends = f.iloc[[0, -1]]  # their regions may go on in other partitions
        yield pd.DataFrame({"a": -1, "b": -1, "tree": ends["tree"], "key": ends["key"]})

    out = stage(rows.mapInPandas(run, "a long, b long, tree int, key binary"), "pairs")
    return out.filter("tree < 0 and a <> b").select("a", "b").distinct(), out.filter("tree >= 0").select(_region()).distinct()


def _region() -> Column:
    return F.xxhash64("tree", F.substring("key", 1, 4 * BASE)).alias("region")


def _regions_of(reps: DataFrame) -> DataFrame:
    """doc_id and its region in every tree."""
    at = F.sequence(F.lit(0), F.lit(TREES - 1))
    own = F.transform(at, lambda t: F.xxhash64(t, F.substring(F.col("sig"), t * (4 * DEPTH) + 1, F.lit(4 * BASE))))
    return reps.select("doc_id", own.alias("regions"))


GROUP = ["region", "p", "q"]


def _plausible(rows: DataFrame, threshold: float, margin: float, percent: int) -> DataFrame:
    """Per group of two slices its plausible pairs between different components: docs, labels, and pairs as positions in docs.

    A pair is left to the first tree in which its two sets share a region.
    """
    least = threshold - margin

    def weigh(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["side", "component"], ignore_index=True)
        n_left = int((f["side"] == 0).sum())
        one = key[1] == key[2]  # a slice with itself
        ids, label, size = f["doc_id"].to_numpy(), f["component"].to_numpy(), f["n_shingles"].to_numpy()
        low = _matrix(f["low"], "u1", PERMUTATIONS // 2)
        regions = np.array(f["regions"].tolist(), dtype=np.int64)
        tree = int(f["tree"].iloc[0])
        left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i in range(n_left):
            at = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1 if one else np.flatnonzero(label[n_left:] != label[i]) + n_left
            at = at[100 * np.minimum(size[at], size[i]) >= percent * np.maximum(size[at], size[i])]
            at = at[_similarity(_EQUAL[low[at] ^ low[i]].sum(axis=1, dtype=np.uint8)) >= least]
            at = at[~(regions[at, :tree] == regions[i, :tree]).any(axis=1)]
            left.append(np.full(len(at), i))
            right.append(at)
        left, right = np.concatenate(left), np.concatenate(right)
        if not len(left):
            return pd.DataFrame([], columns=[*GROUP, "docs", "labels", "i", "j"])
        used, pos = np.unique(np.r_[left, right], return_inverse=True)
        i, j = pos[: len(left)].astype("<u4"), pos[len(left) :].astype("<u4")
        return pd.DataFrame({"region": [key[0]], "p": [key[1]], "q": [key[2]], "docs": [ids[used]], "labels": [label[used]], "i": [i.tobytes()], "j": [j.tobytes()]})

    return rows.groupBy(*GROUP).applyInPandas(weigh, "region long, p int, q int, docs array<long>, labels array<long>, i binary, j binary")


def _linked(pairs: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of one group that join its components: pairs confirmed on full sets, those within what is joined already left out."""
    none = pd.DataFrame({"a": [], "b": []})
    if not len(pairs):
        return none
    row, sets = pairs.iloc[0], sets.sort_values("doc_id", ignore_index=True)
    docs, label = np.asarray(row["docs"]), np.unique(row["labels"], return_inverse=True)[1]
    left, right = np.frombuffer(row["i"], dtype="<u4").astype(np.int64), np.frombuffer(row["j"], dtype="<u4").astype(np.int64)
    own = sets["doc_id"].to_numpy()
    at, end = np.searchsorted(own, docs), np.searchsorted(own, docs, side="right")
    if (end - at > 1).any():  # rows that repeat an id: every text of it
        both = [(x, y) for i, j in zip(left, right, strict=True) for x in range(at[i], end[i]) for y in range(at[j], end[j])]
        left, right = np.array(sorted(both), dtype=np.int64).reshape(-1, 2).T
    else:
        left, right = at[left], at[right]
    order = np.argsort(docs)
    label = label[order][np.searchsorted(docs[order], own)]
    docs = own
    parts_ = [np.frombuffer(x, dtype=np.uint64) for x in sets["s"]]
    size = np.array([len(x) for x in parts_])
    words, flat = np.unique(np.concatenate(parts_), return_inverse=True)
    start = np.r_[0, np.cumsum(size)]
    has = np.zeros(len(words), dtype=bool)
    out = []
    cuts = np.flatnonzero(np.r_[True, left[1:] != left[:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        i, js = left[lo], right[lo:hi]
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        mine = flat[start[i] : start[i + 1]]
        has[mine] = True
        n = size[js]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(start[js] - (ends - n), n)
        both = np.add.reduceat(has[flat[at]].astype(np.int64), ends - n)
        has[mine] = False
        for j in js[100 * both >= percent * (size[i] + n - both)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((min(docs[i], docs[j]), max(docs[i], docs[j])))
    return pd.DataFrame(out, columns=["a", "b"]) if out else none


def between(reps: DataFrame, regions: DataFrame, found: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, margin: float = MARGIN) -> DataFrame:
    """Links (a < b) of `regions` between different components of `found(node, component)`, enough to join all that belong together.

    In each region every set outside its commonest component meets every set of another one. Both
    kinds are dealt over slices, and two slices meet in one group.
    """
    rows = may_contain(_tree_rows(reps).select("doc_id", "tree", _region()), regions, "region").join(regions, "region")
    rows = rows.join(found, F.col("doc_id") == F.col("node"), "left").select("region", "tree", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    rows = stage(rows.join(reps.select("doc_id", "n_shingles"), "doc_id"), "open")
    counts = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    per = counts.groupBy("region").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.max_by("w", F.struct("n", "component")).alias("main_w"))
    slices = lambda n, w: F.greatest(F.ceil(n / SLICE), F.ceil(w / SLICE_SHINGLES)).cast("int")
    per = per.filter("components > 1").select("region", F.col("main.component").alias("main"), slices(F.col("n") - F.col("main.n"), F.col("w") - F.col("main_w")).alias("few"), slices(F.col("main.n"), F.col("main_w")).alias("many"))
    rows = rows.join(stage(per, "mixed"), "region")
    minor = F.col("component") != F.col("main")
    own = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.when(minor, F.col("few")).otherwise(F.col("many"))).cast("int")
    # slices 0..few-1 hold what is outside the commonest component and meet each other and all slices -1, -2, .. of that
    rows = rows.withColumn("own", F.when(minor, own).otherwise(-1 - own))
    others = F.when(minor, F.sequence(-F.col("many"), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    rows = rows.withColumn("other", F.explode(others))
    first = (F.col("own") >= 0) & ((F.col("other") < 0) | (F.col("own") <= F.col("other")))
    rows = rows.select("region", F.when(first, F.col("own")).otherwise(F.col("other")).alias("p"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("q"), (~first).cast("int").alias("side"), "tree", "doc_id", "component", "n_shingles")
    rows = rows.join(reps.select("doc_id", "low").join(_regions_of(reps), "doc_id"), "doc_id")
    packed = stage(_plausible(rows, percent / 100, margin, percent), "plausible")
    own = [f"{c}_of" for c in GROUP]
    places = packed.select(*[F.col(c).alias(f"{c}_of") for c in GROUP], F.explode("docs").alias("doc_id"))
    s = full_sets(places.select("doc_id").distinct(), docs, id_col, text_col, shingle)
    return packed.groupBy(*GROUP).cogroup(places.join(s, "doc_id").groupBy(*own)).applyInPandas(lambda left, right: _linked(left, right, percent), "a long, b long").distinct()


def full_sets(needed: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """doc_id and the shingle set (sorted 64-bit hashes) of the ids in `needed`."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "s": [shingle_set(t, n).tobytes() for t in b["text"]]})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # an inner join: a semi join would be pushed below the pre-filter
    texts = may_contain(texts, needed, "doc_id").join(needed, "doc_id")
    return stage(texts.mapInPandas(sets, "doc_id long, s binary"), "sets")


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union| on the full shingle sets."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            a, b = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pd.Series(out, dtype=bool)

    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    s = full_sets(needed, docs, id_col, text_col, n)
    left = s.select(F.col("doc_id").alias("a"), F.col("s").alias("s_a"))
    right = s.select(F.col("doc_id").alias("b"), F.col("s").alias("s_b"))
    return pairs.join(left, "a").join(right, "b").filter(linked("s_a", "s_b")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    component_id is the smallest id reachable over links of similarity percent/100 or more. Texts
    without words (null, empty) and rows with a null id link with nothing: their component is
    their own id and they are kept. Rows that repeat an id count as one document with the texts' links.
    """
    all_rows = stage(sketches(docs, id_col, text_col, shingle), "sketches")
    full = F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()
    groups = all_rows.filter(full).groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("low").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups, "groups")
    reps = groups.select(F.col("rep").alias("doc_id"), "n_shingles", "sig", "low")
    pairs, regions = candidates(reps, percent / 100)
    found = components(confirm(stage(pairs, "plausible"), docs, id_col, text_col, shingle, percent))
    # a pair left out here is in one component already, so one further round is enough
    more = stage(between(reps, stage(regions, "regions"), found, docs, id_col, text_col, shingle, percent), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    by_key = groups.select("set_key", "rep", "n").join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"), "n")
    cols = ["doc_id", "n_shingles", "component_id"]
    linked = join_spread(all_rows.filter(full).select("doc_id", "n_shingles", "set_key"), stage(by_key, "by-key"), "set_key", "n", ["doc_id"]).select(*cols)
    alone = all_rows.filter(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the documents that are not the smallest id of their group; columns unchanged, whatever their names."""
    marks = near_duplicates(docs, shingle=shingle, percent=percent)
    gone = marks.filter("not kept").select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("row"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
