from __future__ import annotations

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from paperloom.llm import merkle

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def _hash(parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def _levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [_hash(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def _up(levels, i, digest):
    """Proof siblings and folded top of node `i` with `digest` in its place."""
    proof = []
    for nodes in levels[:-1]:
        lo = i // 3 * 3
        run = nodes[lo : lo + 3]
        proof += [x for j, x in enumerate(run) if j != i - lo]
        run[i - lo] = digest
        digest, i = _hash(run), i // 3
    return proof, digest


def plain(rows):
    """All rows of op11 the slow way: doc_id, leaf, subroot, root, proof, folded root, verified."""
    key = lambda s: (s is not None, (s or "").encode())
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=key)
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees[s] = _levels([_leaf(r) for r in groups[s]])
    top = _levels([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            other = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                other = (*r[:4], r[4].replace("\n", ""))
            proof, folded = _up(trees[s], i, _leaf(other))
            more, folded = _up(top, g, folded)
            out.append((r[0], _leaf(r), trees[s][-1][0], top[-1][0], _hash(proof + more), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def _check(spark, rows, got=None):
    got = merkle.op11(spark.createDataFrame(rows, DDL)) if got is None else got
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_edges(spark):
    rows = [(i, s, None if i % 3 else "de", i, t) for i, (s, t) in enumerate([(None, "a\nb"), ("", None), ("", ""), ("é", "x\n"), ("z", "\n\n"), ("Z", "ü😀" * 20000), (None, "q")])]
    rows += [(None, "z", None, None, None), (2, "", "en", 1, "again\n"), (2, "", "en", 1, "again\n"), (9223372036854775807, "z", "en", 0, "a\nb"), (-9223372036854775808, "z", "en", 0, "a\nb")]
    _check(spark, rows)
    assert merkle.op11(spark.createDataFrame([], DDL)).collect() == []
    _check(spark, rows[:1])


@pytest.mark.parametrize("levels", [1, 2])
def test_blocks_of_blocks(spark, levels):
    """Small blocks: several rounds below and above the subroots."""
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "en", i, f"text {i}\n" * (i % 4)) for i in range(300)] + [(1000 + i, f"single{i}", None, i, "\n") for i in range(31)]
    _check(spark, rows, merkle.op11(spark.createDataFrame(rows, DDL), levels))


def test_extra_columns_and_other_fields(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, None)], "id long, g string, `te.xt` string").withColumns({"idx": F.lit(5), "root": F.lit("r")})
    got = {r["doc_id"]: r for r in merkle.manifest(df, fields=["te.xt"], id_col="id", group_col="g", changed={"te.xt": F.lit("z")}, where=F.col("id") == 2).collect()}
    a, b = _leaf(["x"]), _leaf(["y"])
    assert got[1]["subroot"] == _hash([a, b]) and got[1]["verified"] and not got[2]["verified"] and got[3]["subroot"] == got[3]["leaf"] == _hash(["-"])
    assert got[2]["root"] == _hash([_hash(["-"]), _hash([a, b])]) and got[2]["folded_root"] == _hash([_hash(["-"]), _hash([a, _leaf(["z"])])])


def test_query(spark, sf):
    from paperloom.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    _check(spark, rows, queries()["op11_merkle"](spark, sf))
