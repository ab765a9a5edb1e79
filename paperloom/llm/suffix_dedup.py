"""Exact repeated-substring removal with suffix arrays (operator 3).

A byte goes if a string of `LENGTH` bytes around it also starts in a document with a smaller id.

1. Documents are read in batches. Of the `K`-grams in every LENGTH-byte window the one with the
   smallest hash is its sample, so equal windows have equal samples at the same place. Each batch
   sorts the keys of its sampled suffixes; per key range the batches' sorted runs are merged by
   binary search, which leaves the samples that more than one place has.
2. Consecutive windows with one shared sample make a block of text. Blocks go to content shards
   by the sample's key, so windows that may be equal meet in one shard. Equal blocks are one.
   Blocks are counted by key first: a key with more of them than a shard should hold (a 20-gram in
   very many contexts) is dealt window by window, by key and the window's text.
3. Every shard builds the suffix array of its blocks by Larsson-Sadakane refinement and
   the longest common prefixes by Kasai's method. Neighbours that share LENGTH bytes are equal
   windows; the smallest document id of each such group goes back to the batches.
4. Each batch marks the bytes of windows that a smaller id has, and cuts them.

Windows without a shared sample cannot occur twice, so the result is exact. Work on a batch or a
shard is bounded; a passage that very many documents hold is one block per batch.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stage, stage_dir

LENGTH, K = 50, 20
SPAN = LENGTH - K + 1  # K-grams in a window
BATCH_BYTES, SHARD_BYTES, RANGE_BYTES = 4_000_000, 4_000_000, 256_000_000
#: Stands for no owner of a window: the largest id is never smaller than another.
NO_ID = np.iinfo(np.int64).max


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expand(data: bytes, dtype="u1") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(data)), dtype=dtype)


# ---- samples -------------------------------------------------------------------------------


def window_samples(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a sample: first window, number of windows, key of the sampled K-gram, a mark of the run's text (its key and the K-grams at its ends).

    `x` holds the documents' bytes one after the other, `ends` where each one ends.
    """
    n = len(x)
    none = np.zeros(0, dtype=np.int64)
    if n < LENGTH:
        return none, none, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15

    def join(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        m = len(x) - width + 1
        return a[:m] * np.uint64(pow(base, width // 2, 1 << 64)) + b[:m]

    h1 = x.astype(np.uint64) + np.uint64(1)
    h2 = join(h1, h1[1:], 2)
    h4 = join(h2, h2[2:], 4)
    h8 = join(h4, h4[4:], 8)
    h16 = join(h8, h8[8:], 16)
    m = n - K + 1
    h = h16[:m] * np.uint64(pow(base, 4, 1 << 64)) + h4[16 : 16 + m]
    del h1, h2, h8, h16, h4
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    bits = np.uint64(max(1, int(n).bit_length()))
    low = ((h >> bits) << bits) | np.arange(m, dtype=np.uint64)  # leftmost of equal ones
    width, windows = 1, n - LENGTH + 1
    best = low
    while width * 2 <= SPAN:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    best = np.minimum(best[:windows], best[SPAN - width : SPAN - width + windows])
    place = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    inside = np.ones(windows, dtype=bool)  # windows that lie in one document
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        inside[max(s, e - LENGTH + 1) : e] = False
    new = np.r_[True, (place[1:] != place[:-1]) | ~inside[:-1]] & inside
    first = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True])
    key = h[place[first]]
    mark = (key * np.uint64(base) + h[first]) * np.uint64(base) + h[stop + LENGTH - K]
    return first, stop - first + 1, key, mark


def _split_key(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Range number (top bits) and the next 32 bits of a key."""
    return (key >> np.uint64(64 - bits)).astype(np.int64), ((key >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _pack_ids(ids: list) -> bytes:
    """Ids, then a mask of the nulls if there are any: every long is an id."""
    null = np.array([i is None for i in ids], dtype=bool)
    return np.array([NO_ID if i is None else i for i in ids], dtype=np.int64).tobytes() + null.tobytes() * bool(null.any())


def _unpack_ids(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    null = np.frombuffer(data, dtype=bool, offset=8 * n) if len(data) > 8 * n else np.zeros(n, dtype=bool)
    return np.frombuffer(data, dtype=np.int64, count=n), null


BATCH_SCHEMA = "batch long, bucket int, data binary, counts binary, ids binary, ends binary"


def _batches(docs: DataFrame, bits: int, batch_bytes: int) -> DataFrame:
    """Per batch one row with its documents (bucket -1) and one per key range with its sorted sample keys and how many different runs have each."""
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("data", "counts", "ids", "ends")]])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def finish(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            nonlocal number
            x = np.frombuffer(b"".join(texts), dtype=np.uint8)
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            rows = [(number, -1, _squeeze(x.tobytes()), None, _pack_ids(ids), ends.tobytes())]
            _, _, key, mark = window_samples(x, ends)
            _, once = np.unique(mark, return_index=True)
            bucket, rest = _split_key(np.sort(key[once]), bits)
            head = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1])]) if len(rest) else np.zeros(0, dtype=np.int64)
            counts = np.minimum(np.diff(np.r_[head, len(rest)]), 65535).astype(np.uint16)
            bucket, rest = bucket[head], rest[head]
            cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            for b in np.flatnonzero(cuts[:-1] < cuts[1:]).tolist():
                part = slice(cuts[b], cuts[b + 1])
                rows.append((number, b, rest[part].tobytes(), _squeeze(counts[part].tobytes()), None, None))
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        ids, texts, size = [], [], 0
        for b in incoming:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or b""
                if texts and size + len(t) > batch_bytes:
                    yield finish(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield finish(ids, texts)

    return docs.mapInArrow(run, BATCH_SCHEMA)


def merge_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Keys that occur in more than one sorted run: merged pairwise, equal keys found by binary search."""
    twice = [np.zeros(0, dtype=np.uint32)]
    while len(runs) > 1:
        merged = []
        for a, b in zip(runs[::2], runs[1::2], strict=False):
            at = np.searchsorted(a, b)
            hit = (at < len(a)) & (a[np.minimum(at, max(0, len(a) - 1))] == b) if len(a) else np.zeros(len(b), dtype=bool)
            twice.append(b[hit])
            merged.append(np.insert(a, at[~hit], b[~hit]))
        runs = merged + (runs[-1:] if len(runs) % 2 else [])
    return np.unique(np.concatenate(twice))


def _shared_keys(keys: DataFrame, hot_runs: int) -> DataFrame:
    """Per batch and key range the keys that other batches have too, and those of them with over `hot_runs` different runs in all batches."""

    def merge(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(d, dtype=np.uint32) for d in f["data"]]
        twice = merge_runs(list(runs))
        total = np.zeros(len(twice), dtype=np.int64)
        places = []
        for run, counts in zip(runs, f["counts"], strict=True):
            at = np.searchsorted(twice, run)
            hit = (at < len(twice)) & (twice[np.minimum(at, max(0, len(twice) - 1))] == run) if len(twice) else np.zeros(len(run), dtype=bool)
            places.append(at[hit].astype(np.uint32))
            total[places[-1]] += _expand(counts, np.uint16)[hit]
        hot = total > hot_runs
        out = [(batch, int(key[0]), twice[at].tobytes(), twice[at[hot[at]]].tobytes()) for batch, at in zip(f["batch"], places, strict=True) if len(at)]
        return pd.DataFrame(out, columns=["batch", "bucket", "data", "hot"])

    return keys.groupBy("bucket").applyInPandas(merge, "batch long, bucket int, data binary, hot binary")


# ---- blocks --------------------------------------------------------------------------------

BLOCK_SCHEMA = "shard int, batch long, data binary, lengths binary, number binary, low binary, high binary"


def _find_blocks(row: pd.Series, shared: pd.DataFrame, bits: int) -> tuple:
    """Bytes, ids and ends of a batch; first window, document and block number of each run with a shared sample; keys and texts of its blocks.

    A run with a hot key is cut into its windows, whose keys take in their texts.
    """
    x, ends = _expand(row["data"]), np.frombuffer(row["ends"], dtype=np.int64)
    ids, null = _unpack_ids(row["ids"], len(ends))
    first, count, key, _ = window_samples(x, ends)
    doc = np.searchsorted(ends, first, side="right")
    use = ~null[doc]
    first, count, key, doc = first[use], count[use], key[use], doc[use]
    bucket, rest = _split_key(key, bits)
    whole = (bucket.astype(np.uint64) << np.uint64(32)) | rest
    listed = lambda c: [np.zeros(0, dtype=np.uint64)] + [(np.uint64(b) << np.uint64(32)) | np.frombuffer(d, dtype=np.uint32).astype(np.uint64) for b, d in zip(shared["bucket"], shared[c], strict=True)]
    known = listed("data")
    # samples that two documents of this batch have
    order = np.lexsort((doc, whole))
    pair = np.flatnonzero((whole[order][1:] == whole[order][:-1]) & (doc[order][1:] != doc[order][:-1]))
    known.append(whole[order][pair])
    use = np.isin(whole, np.unique(np.concatenate(known)))
    first, count, key, doc, whole = first[use], count[use], key[use], doc[use], whole[use]
    hot = np.isin(whole, np.concatenate(listed("hot")))
    if hot.any():
        n = np.where(hot, count, 1)
        first = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        count, key, doc, hot = np.repeat(np.where(hot, 1, count), n), np.repeat(key, n), np.repeat(doc, n), np.repeat(hot, n)
    text = x.tobytes()
    found: dict[bytes, int] = {}
    number = np.fromiter((found.setdefault(text[a : a + c + LENGTH - 1], len(found)) for a, c in zip(first.tolist(), count.tolist(), strict=True)), dtype=np.int64, count=len(first))
    keys = np.zeros(len(found), dtype=np.uint64)
    keys[number] = key
    if hot.any():
        texts = list(found)
        part = np.unique(number[hot])
        keys[part] += np.array([zlib.crc32(texts[i]) for i in part.tolist()], dtype=np.uint64) << np.uint64(32)
    return x, ids, ends, first, doc, number, keys, list(found)


def _blocks_of_batch(payload: pd.DataFrame, shared: pd.DataFrame, bits: int, shards: int) -> pd.DataFrame:
    """The distinct blocks of a batch by content shard, with the smallest and largest id that has each."""
    columns = ["shard", "batch", "data", "lengths", "number", "low", "high"]
    if not len(payload):
        return pd.DataFrame([], columns=columns)
    row = payload.iloc[0]
    _, ids, _, _, doc, number, keys, texts = _find_blocks(row, shared, bits)
    low, high = np.full(len(texts), NO_ID, dtype=np.int64), np.full(len(texts), -NO_ID, dtype=np.int64)
    np.minimum.at(low, number, ids[doc])
    np.maximum.at(high, number, ids[doc])
    shard = ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % shards
    blocks = np.array(texts, dtype=object)
    rows = []
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1], True]) if len(order) else np.zeros(1, dtype=np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = order[lo:hi]
        own = blocks[part].tolist()
        rows.append((int(shard[part[0]]), row["batch"], _squeeze(b"".join(own)), np.array([len(t) for t in own], dtype=np.uint16).tobytes(), part.astype(np.uint32).tobytes(), _squeeze(low[part].tobytes()), _squeeze(high[part].tobytes())))
    return pd.DataFrame(rows, columns=columns)


# ---- suffix arrays -------------------------------------------------------------------------


def _words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian integer (zeros beyond the end)."""
    w = np.r_[x, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
    for bits in (8, 16, 32):
        k = bits // 8
        w = (w[: len(w) - k] << np.uint64(bits)) | w[k:]
    return np.r_[w[: len(x)], np.zeros(8, dtype=np.uint64)]


def suffix_array(x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Suffixes of the blocks in `x` in order; `rest` is the number of bytes up to the block's end.

    Larsson-Sadakane refinement: suffixes sorted by their first h symbols are ranked by group; only
    groups of more than one are sorted again, by the rank of the suffix h further on, which
    doubles h. A suffix that is a prefix of another comes first; equal ones by place.
    """
    n = len(x)
    if not n:
        return np.zeros(0, dtype=np.int64)
    used = np.bincount(x, minlength=256) > 0
    if used.sum() < 256:  # bytes as codes from 1: eight symbols a key, zeros after the block's end
        h = 8
        beyond = np.uint64(8) * np.maximum(0, 8 - rest).astype(np.uint64)
        key = (_words(np.cumsum(used).astype(np.uint8)[x])[:n] >> beyond) << beyond
    else:
        h = 7
        padded = np.r_[x, np.zeros(h, dtype=np.uint8)]
        key = np.zeros(n, dtype=np.int64)
        for j in range(h):
            key <<= 9
            key += np.where(rest > j, padded[j : j + n].astype(np.int64) + 1, 0)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    longest = int(rest.max())
    while True:
        open_at = np.flatnonzero(~(new & np.r_[new[1:], True]))  # groups of more than one
        if not len(open_at):
            return order
        s = order[open_at]
        if h >= longest:
            order[open_at] = s[np.lexsort((s, rank[s]))]
            return order
        after = np.where(rest[s] > h, rank[np.minimum(s + h, n - 1)] + 1, 0)
        if n < 1 << 21:  # rank, next rank and place fit one integer, which sorts faster than by index
            key = np.sort((rank[s] << 42) | (after << 21) | np.arange(len(s)))
            s = s[key & ((1 << 21) - 1)]
            key >>= 21
        else:
            key = (rank[s] << 32) | after
            o = np.argsort(key)
            key, s = key[o], s[o]
        order[open_at] = s
        head = np.r_[True, key[1:] != key[:-1]]
        new[open_at] = head
        rank[s] = np.maximum.accumulate(np.where(head, open_at, 0))
        h *= 2


_LIMITS = [np.uint64(1) << np.uint64(8 * k) for k in range(8)]


def common_prefixes(x: np.ndarray, rest: np.ndarray, order: np.ndarray, lanes: int = 4096, least: int = 1) -> np.ndarray:
    """For each place in `order`, the bytes its suffix shares with the one before it (0 for the first).

    Kasai's method: from one suffix to the next in text order the common prefix shrinks by one at
    most. `lanes` stretches of the text are walked at once, eight bytes a step. Suffixes shorter than
    `least` are left out (0).
    """
    n = len(x)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    lcp = np.zeros(n, dtype=np.int64)
    want = np.flatnonzero((rest >= least) & (before >= 0))
    if not len(want):
        return lcp[order]
    follows = np.r_[False, (want[1:] == want[:-1] + 1) & (rest[want[1:]] < rest[want[:-1]])]
    words = _words(x)
    size = -(-len(want) // min(lanes, len(want)))
    k = np.arange(0, len(want), size)
    stop = np.minimum(k + size, len(want))
    h = np.zeros(len(k), dtype=np.int64)
    while len(k):
        at = want[k]
        b = before[at]
        most = np.minimum(rest[at], rest[b])
        differ = words[np.minimum(at + h, n)] ^ words[np.minimum(b + h, n)]
        same = np.zeros(len(k), dtype=np.int64)
        for limit in _LIMITS:
            same += differ < limit
        h = np.minimum(h + same, most)
        done = (same < 8) | (h == most)
        lcp[at[done]] = h[done]
        k = k + done
        live = k < stop
        if not live.all():
            k, stop, h, done = k[live], stop[live], h[live], done[live]
        h = np.where(done, np.where(follows[np.minimum(k, len(want) - 1)], np.maximum(h - 1, 0), 0), h)
    return lcp[order]


def window_owners(x: np.ndarray, lengths: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For every place of the blocks in `x`: the smallest id of any block that has the window starting there (NO_ID: no window)."""
    block = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    rest = ends[block] - np.arange(len(x))
    order = suffix_array(x, rest)
    same = common_prefixes(x, rest, order, least=LENGTH) >= LENGTH
    head = np.flatnonzero(~same)
    owner = np.minimum.reduceat(low[block[order]], head) if len(head) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(x), dtype=np.int64)
    out[order] = np.repeat(owner, np.diff(np.r_[head, len(x)]))
    out[rest < LENGTH] = NO_ID
    return out


def _shard_owners(blocks: DataFrame) -> DataFrame:
    """Per batch and shard: (block, first window, last window, smallest id) where an id over the smallest has the block."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        texts: dict[bytes, int] = {}
        places = []
        for row in f.itertuples():
            data = _expand(row.data).tobytes()
            cut = np.r_[0, np.cumsum(np.frombuffer(row.lengths, dtype=np.uint16), dtype=np.int64)].tolist()
            mine = np.fromiter((texts.setdefault(data[a:b], len(texts)) for a, b in zip(cut[:-1], cut[1:], strict=True)), dtype=np.int64, count=len(cut) - 1)
            places.append((row.batch, mine, np.frombuffer(row.number, dtype=np.uint32), _expand(row.low, np.int64), _expand(row.high, np.int64)))
        low = np.full(len(texts), NO_ID, dtype=np.int64)
        for _, mine, _, lo, _ in places:
            np.minimum.at(low, mine, lo)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        x = np.frombuffer(b"".join(texts), dtype=np.uint8)
        owner = window_owners(x, lengths, low)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        block = np.repeat(np.arange(len(lengths)), lengths)
        real = owner != NO_ID
        head = real & np.r_[True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])]
        tail = real & np.r_[head[1:] | ~real[1:], True]
        a, b = np.flatnonzero(head), np.flatnonzero(tail)
        of, a_off, b_off, who = block[a], a - starts[block[a]], b - starts[block[a]], owner[a]
        lo_at, hi_at = np.searchsorted(of, np.arange(len(lengths))), np.searchsorted(of, np.arange(len(lengths)), side="right")
        rows = []
        for batch, mine, number, _, high in places:
            n = (hi_at - lo_at)[mine]
            pick = np.repeat(lo_at[mine] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            use = who[pick] < np.repeat(high, n)
            pick = pick[use]
            if len(pick):
                rows.append((batch, _squeeze(np.repeat(number, n)[use].tobytes()), _squeeze(np.stack([a_off[pick], b_off[pick]]).astype(np.uint16).tobytes()), _squeeze(who[pick].tobytes())))
        return pd.DataFrame(rows, columns=["batch", "number", "windows", "owner"])

    return blocks.groupBy("shard").applyInPandas(run, "batch long, number binary, windows binary, owner binary")


# ---- cutting -------------------------------------------------------------------------------


def _cut_batch(payload: pd.DataFrame, marks: pd.DataFrame, bits: int, with_text: bool) -> pd.DataFrame:
    """Per document its removed spans and what is left."""
    columns = ["doc_id", "n_bytes", "n_removed", "span_starts", "span_ends", "kept_sha256"] + ["kept"] * with_text
    if not len(payload):
        return pd.DataFrame([], columns=columns)
    row = payload.iloc[0]
    got = marks[marks["owner"].notna()]
    x, ids, ends, first, doc, number, _, _ = _find_blocks(row, marks[marks["owner"].isna()], bits)
    depth = np.zeros(len(x) + 1, dtype=np.int64)
    if len(got):
        block = np.concatenate([_expand(d, np.uint32) for d in got["data"]])
        span = np.concatenate([_expand(d, np.uint16).reshape(2, -1) for d in got["windows"]], axis=1).astype(np.int64)
        owner = np.concatenate([_expand(d, np.int64) for d in got["owner"]])
        order = np.argsort(block, kind="stable")
        block, span, owner = block[order], span[:, order], owner[order]
        lo, hi = np.searchsorted(block, number), np.searchsorted(block, number, side="right")
        n = hi - lo
        pick = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        at = np.repeat(first, n)
        use = owner[pick] < np.repeat(ids[doc], n)
        at, pick = at[use], pick[use]
        np.add.at(depth, at + span[0, pick], 1)
        np.add.at(depth, at + span[1, pick] + LENGTH, -1)
    gone = np.cumsum(depth[:-1]) > 0
    starts = np.r_[0, ends[:-1]]
    edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
    border = np.zeros(len(x) + 1, dtype=bool)
    border[starts[starts < len(x)]] = True
    a = np.flatnonzero((edge[: len(x)] == 1) | (border[: len(x)] & gone))
    b = np.flatnonzero((edge == -1) | (border & np.r_[False, gone]) & np.r_[gone, False])
    text = x.tobytes()
    rows = []
    i0, i1 = np.searchsorted(a, starts), np.searchsorted(a, ends)
    _, null = _unpack_ids(row["ids"], len(ends))
    for own, unknown, s, e, p, q in zip(ids.tolist(), null.tolist(), starts.tolist(), ends.tolist(), i0.tolist(), i1.tolist(), strict=True):
        kept, at = [], s
        for u, v in zip(a[p:q].tolist(), b[p:q].tolist(), strict=True):
            kept.append(text[at:u])
            at = v
        kept.append(text[at:e])
        left = b"".join(kept)
        rows.append((None if unknown else own, e - s, e - s - len(left), a[p:q] - s, b[p:q] - s, hashlib.sha256(left).hexdigest(), left)[: len(columns)])
    # ids as they are: a null among them would turn a column of large ones into floats
    return pd.DataFrame(rows, columns=columns).assign(doc_id=pd.array([r[0] for r in rows], dtype="Int64"))


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """`df` written once to the shared folder in buckets of `key`, so that later grouping by it moves no text."""
    spark = df.sparkSession
    name = f"paperloom_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{stage_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_text: bool = True, batch_bytes: int = BATCH_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, span_starts, span_ends, kept_sha256[, kept] for every row.

    Spans are byte ranges within the document, maximal and in order. Null texts are empty. A row with a
    null id loses nothing and is nobody's source; rows with equal ids leave each other alone.
    Memory follows `batch_bytes` and the longest document.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    total = d.agg(F.sum(F.length("text"))).first()[0] or 0
    # key ranges: as many as partitions, and more where a range would hold the keys of over RANGE_BYTES of text
    bits = max(4, int(np.ceil(np.log2(max(parts(spark), total / RANGE_BYTES)))))
    batches = _bucketed(_batches(d, bits, batch_bytes), "batch", parts(spark))
    payload = batches.filter("bucket = -1").select("batch", "data", "ids", "ends")
    shared = stage(_shared_keys(batches.filter("bucket >= 0").select("batch", "bucket", "data", "counts"), shard_bytes // (LENGTH + SPAN)), "shared")
    shards = max(4, -(-total // shard_bytes))

    def blocks(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _blocks_of_batch(left, right, bits, shards)

    made = payload.groupBy("batch").cogroup(shared.groupBy("batch")).applyInPandas(blocks, BLOCK_SCHEMA)
    nothing = F.lit(None).cast("binary")
    owners = _shard_owners(made).select("batch", F.lit(-1).alias("bucket"), F.col("number").alias("data"), nothing.alias("hot"), "windows", "owner")
    marks = shared.select("batch", "bucket", "data", "hot", nothing.alias("windows"), nothing.alias("owner")).union(owners)
    schema = "doc_id long, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept_sha256 string" + ", kept binary" * with_text

    def cut(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _cut_batch(left, right, bits, with_text)

    return payload.groupBy("batch").cogroup(marks.groupBy("batch")).applyInPandas(cut, schema)
