"""Range, containment, many-pattern and as-of joins against all pairs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperloom.operators import fillplan, tasks, templates
from paperloom.streaming import logs

NODES = "doc_id string, pos long, node_id string, kind string, text string"
CANDS = "doc_id string, candidate_id string, start_pos long, end_pos long, fillable_slots int"


def _cands(rng, n, most, slots=6):
    out = []
    for i in range(n):
        a = rng.randrange(most)
        out.append((f"d{i % 3}", f"c{i}", a, a + rng.choice([0, 1, 15, 16, 17, rng.randrange(most)]), rng.choice([None, *range(slots)])))
    return [*out, ("d9", "alone", 0, 5, 1), ("d0", "empty", 9, 3, 1), *out[:3]]


def test_nodes_of_overlapping_ranges(spark):
    rng = random.Random(1)
    nodes = [(d, p, f"n{p}", "paragraph", f"t{p}") for d in ("d0", "d1", "d2", "d7") for p in range(700)]
    cands = _cands(rng, 80, 700) + [("d2", "high", 690, 10**9, 1)]
    out = templates.candidate_nodes(spark.createDataFrame(cands, CANDS), spark.createDataFrame(nodes, NODES))
    want = sorted((d, c, p) for d, c, a, b, _ in cands for e, p, *_ in nodes if d == e and a <= p <= b)
    assert sorted((r["doc_id"], r["candidate_id"], r["pos"]) for r in out.collect()) == want
    assert out.columns == ["doc_id", "pos", "node_id", "kind", "text", "candidate_id"]
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any(">=" in x or "<=" in x for x in joins)


@pytest.mark.parametrize("slots", [1, 2, 9, 200])
def test_contained_candidates(spark, slots):
    cands = _cands(random.Random(slots), 150, 60, slots)
    got = templates.prune_contained(spark.createDataFrame(cands, CANDS))
    want = [c for c in cands if not any(o[0] == c[0] and o[2] <= c[2] and o[3] >= c[3] and o[4] is not None and c[4] is not None and o[4] > c[4] for o in cands)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert templates.prune_contained(spark.createDataFrame([], CANDS)).count() == 0


def test_very_many_candidates_of_one_document(spark):
    """Nested ranges: all pairs would be five thousand million."""
    n = 100_000
    cands = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("string").alias("candidate_id"), F.col("id").alias("start_pos"), (2 * n - F.col("id")).alias("end_pos"), (F.col("id") % 40).cast("int").alias("fillable_slots"))
    got = {r["start_pos"] for r in templates.prune_contained(cands).collect()}
    best, want = -1, set()
    for i in range(n):
        if best <= i % 40:
            want.add(i)
        best = max(best, i % 40)
    assert got == want


def test_leaks(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    nodes = [(f"d{i % 3}", i, f"n{i}", rng.choice(["paragraph", "footer"]), rng.choice([None, "", text(12), " " + text(9) + "　", "\U0001f600" * 8])) for i in range(150)]
    cands = _cands(rng, 20, 150)
    outputs = [(d, c, " ".join(t or "" for e, _, _, _, t in rng.sample(nodes, 60) if e == d) + text(60)) for d, c, *_ in cands[:-3]] + [("d0", "unknown", nodes[0][4]), ("d1", "c1", None)]
    got = fillplan.range_leak(spark.createDataFrame(cands, CANDS), spark.createDataFrame(nodes, NODES), spark.createDataFrame(outputs, "doc_id string, candidate_id string, text string"))
    trim = lambda t: (t or "").strip(" 　")
    want = sorted(
        (d, c, n)
        for d, c, a, b, _ in cands
        for e, p, n, k, t in nodes
        if d == e and k == "paragraph" and len(trim(t)) >= 8 and not a <= p <= b and any(o[:2] == (d, c) and trim(t) in (o[2] or "") for o in outputs)
    )
    assert want and sorted(map(tuple, got.collect())) == want


def test_leaks_of_a_long_output(spark):
    """One output of 2,000,000 characters and 30,000 nodes outside its range."""
    nodes = spark.range(30_000).select(F.lit("d").alias("doc_id"), F.col("id").alias("pos"), F.col("id").cast("string").alias("node_id"), F.lit("paragraph").alias("kind"), F.format_string("clause %06d", (F.col("id") * 7)).alias("text"))
    out = "".join(f"clause {i:06d};" for i in range(0, 140_000))
    cands, output = spark.createDataFrame([("d", "c", 0, 9, 1)], CANDS), spark.createDataFrame([("d", "c", out)], "doc_id string, candidate_id string, text string")
    assert fillplan.range_leak(cands, nodes, output).count() == 20_000 - 10


CONFIRM, PREVIEW = "task_id string, plan_digest string, ts timestamp, seq long", "task_id string, plan_digest string, created_at timestamp, seq long, blockers int"


def _log(rng, n):
    """Confirmations and previews in the order they arrive, up to nine minutes late; times also meet and end between milliseconds."""
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = t0 + timedelta(minutes=rng.randrange(600), microseconds=rng.choice([0, 0, 1, 999_999]))
        task, digest = f"t{rng.randrange(6)}", rng.choice(["x", "y", None])
        row = ("c", (task, digest, at, i)) if rng.random() < 0.5 else ("p", (task, digest, at, i, rng.choice([0, 0, 1])))
        rows.append((at + timedelta(seconds=rng.randrange(540)), row))
    return [r for _, r in sorted(rows, key=lambda x: x[0])]


def _outcomes(log, minutes=30):
    out = []
    for kind, row in log:
        if kind == "c":
            task, digest, at, seq = row
            plans = [p for k, p in log if k == "p" and p[0] == task and at - timedelta(minutes=minutes) <= p[2] <= at]
            last = max(plans, key=lambda p: (p[2], p[3]), default=None)
            code = "PLAN_EXPIRED" if last is None or last[1] is None else "PLAN_MISMATCH" if digest is not None and last[1] != digest else "BLOCKED" if last[4] else "OK"
            out.append((task, seq, code))
    return sorted(out)


def test_confirmations_batch_and_stream(spark, tmp_path):
    log = _log(random.Random(2), 500)
    want = _outcomes(log)
    frame = lambda rows, kind: spark.createDataFrame([r for k, r in rows if k == kind], CONFIRM if kind == "c" else PREVIEW)
    got = tasks.valid_confirmations(frame(log, "c"), frame(log, "p"))
    assert sorted(map(tuple, got.collect())) == want and len({c for *_, c in want}) == 4
    # the same log in parts as they arrive; a last event moves the watermark past all others
    end = datetime(2024, 1, 3)
    parts = [log[i : i + 100] for i in range(0, 500, 100)] + [[("c", ("end", None, end, -1)), ("p", ("end", None, end, -2, 0))]]
    for i, part in enumerate(parts):
        for kind in "cp":
            frame(part, kind).coalesce(1).write.parquet(str(tmp_path / kind / f"part{i}"))

    def read(kind):
        return spark.readStream.schema(CONFIRM if kind == "c" else PREVIEW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / kind / "*"))

    q = logs.confirmation_outcomes(read("c"), read("p")).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "k")).start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("outcomes").filter("task_id <> 'end'").collect())) == want
    finally:
        q.stop()


def test_ordered_folds(spark):
    """Text and digest of keys of any type, nulls and ties, over several batches; no array of a key's rows in the plan."""
    from hashlib import sha256

    from paperloom.functions.folds import ordered_fold

    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", None]), rng.choice([None, *range(50)]), rng.choice([None, "", "x", "é😀", "yy"])) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "k int, g string, o int, v string")
    groups: dict = {}
    for k, g, o, v in rows:
        groups.setdefault((k, g), []).append((o is not None, o or 0, v is not None, v or ""))
    want = {key: (";".join(v for *_, some, v in sorted(r) if some), len(r), sum(x[2] for x in r)) for key, r in groups.items()}
    text = ordered_fold(df, ["k", "g"], ["o"], F.col("v"), "text", separator=";")
    assert {(r["k"], r["g"]): (r["text"], r["n"], r["used"]) for r in text.collect()} == want
    sums = ordered_fold(df, ["k", "g"], ["o"], F.col("v"), "sum", separator=";", digest=("<", ">"))
    assert {(r["k"], r["g"]): r["sum"] for r in sums.collect()} == {key: sha256(f"<{t}>".encode()).hexdigest() for key, (t, _, _) in want.items()}
    assert "collect_list" not in sums._jdf.queryExecution().optimizedPlan().toString()
    assert ordered_fold(df.limit(0), ["k"], ["o"], F.col("v"), "text").collect() == []
