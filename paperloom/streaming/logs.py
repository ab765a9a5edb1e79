"""Structured Streaming forms of the log and confirmation operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def diagnostic_counts(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per detail id and stage in tumbling windows; late events are accepted for `late` (streaming R1)."""
    return log.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "detailId", "stage").agg(F.count(F.lit(1)).alias("n"))


def retained(log: DataFrame, detail_id: Column, late: str = "7 days") -> DataFrame:
    """Events of one detail id, each once within the retention (streaming R1)."""
    return log.withWatermark("timestamp", late).filter(F.col("detailId") == detail_id).dropDuplicatesWithinWatermark(["detailId", "timestamp", "code"])


def valid_confirmations(confirms: DataFrame, previews: DataFrame, minutes: int = 30) -> DataFrame:
    """Confirmations with the previews of their task and digest within the time to live (streaming JN20).

    A stream-stream interval join; both watermarks let Spark drop state older than the interval.
    """
    c = confirms.withWatermark("ts", "10 minutes").alias("c")
    p = previews.withWatermark("created_at", "10 minutes").alias("p")
    near = F.expr(f"c.task_id = p.task_id AND c.plan_digest = p.plan_digest AND p.created_at <= c.ts AND p.created_at >= c.ts - INTERVAL {minutes} MINUTES")
    return c.join(p, near).filter("p.blockers = 0").select("c.task_id", "c.plan_digest", "c.ts", "p.created_at")


def confirmation_outcomes(confirms: DataFrame, previews: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """`task_id, seq, outcome` of every confirmation as the batch form gives them, expired and mismatched ones too (streaming JN20).

    State per task: confirmations that wait and the previews they may need. A confirmation waits until the
    watermark has passed it, so a preview that comes late but before that still counts; a timer at the first one that waits
    wakes the task. Previews go once they are older than the time to live before the watermark, but for the
    latest one of each instant nothing else is held. Times are compared to the millisecond.
    """
    micros = lambda c: F.unix_micros(F.col(c)).alias("at")
    p = previews.select("task_id", F.col("created_at").alias("ts"), micros("created_at"), F.lit(0).alias("kind"), "seq", "plan_digest", F.col("blockers").cast("int").alias("blockers"))
    c = confirms.select("task_id", "ts", micros("ts"), F.lit(1).alias("kind"), "seq", "plan_digest", F.lit(0).alias("blockers"))
    events = p.unionByName(c).withWatermark("ts", late)
    keep = minutes * 60_000_000

    def outcome(digest: str | None, at: int, plans: list[tuple]) -> str:
        last = max((x for x in plans if at - keep <= x[1] <= at), key=lambda x: x[1:3], default=None)
        if last is None or last[3] is None:
            return "PLAN_EXPIRED"
        if digest is not None and last[3] != digest:
            return "PLAN_MISMATCH"
        return "BLOCKED" if last[4] > 0 else "OK"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = [*zip(*state.get, strict=True)] if state.exists else []  # kind, at, seq, digest, blockers
        for f in frames:
            rows += [(int(k), int(a), int(s), None if pd.isna(d) else d, 0 if pd.isna(b) else int(b)) for k, a, s, d, b in zip(f["kind"], f["at"], f["seq"], f["plan_digest"], f["blockers"], strict=True)]
        passed = state.getCurrentWatermarkMs() * 1000
        plans = [x for x in rows if x[0] == 0]
        done = [(key[0], s, outcome(d, a, plans)) for k, a, s, d, _ in rows if k == 1 and a <= passed]
        rows = [x for x in rows if (x[1] > passed if x[0] == 1 else x[1] >= passed - keep)]
        if rows:
            state.update(tuple([x[i] for x in rows] for i in range(5)))
            # woken for the first confirmation that waits, or to forget the last preview
            wake = min((x[1] for x in rows if x[0] == 1), default=max(x[1] for x in rows) + keep)
            state.setTimeoutTimestamp(max(passed, wake) // 1000 + 1)
        else:
            state.remove()
        yield pd.DataFrame(done, columns=["task_id", "seq", "outcome"])

    held = "kind array<int>, at array<long>, seq array<long>, digest array<string>, blockers array<int>"
    return events.groupBy("task_id").applyInPandasWithState(step, "task_id string, seq long, outcome string", held, "append", GroupStateTimeout.EventTimeTimeout)
