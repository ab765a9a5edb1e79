"""Tasks, plans, confirmations, inputs and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import TRANSITIONS


def latest_plan(plans: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A new plan supersedes the earlier ones of its candidate."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return plans.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def transition_audit(events: DataFrame, order: list[str]) -> DataFrame:
    """Events whose change of state is not allowed (W6). The first event of a task is not a change."""
    spark = events.sparkSession
    allowed = spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "before string, state string")
    d = events.withColumn("before", F.lag("state").over(Window.partitionBy("task_id").orderBy(*order))).filter("before is not null")
    return d.join(F.broadcast(allowed), ["before", "state"], "left_anti")


def confirmation_outcome(digest: Column, planned: Column, blockers: Column) -> Column:
    """PLAN_EXPIRED without a preview in time, PLAN_MISMATCH, BLOCKED or OK."""
    return F.when(planned.isNull(), "PLAN_EXPIRED").when(planned != digest, "PLAN_MISMATCH").when(blockers > 0, "BLOCKED").otherwise("OK")


def valid_confirmations(confirms: DataFrame, previews: DataFrame, minutes: int = 30) -> DataFrame:
    """Outcome of each confirmation against the latest preview of its task before it (JN20), if that is within the time to live.

    An as-of join: both sides in one order of time per task, the last preview carried along, so a
    confirmation never meets the other previews. A preview of the same instant comes first; of equal ones the largest seq counts.
    """
    p = F.struct(F.col("plan_digest").alias("digest"), "created_at", "blockers")
    events = previews.select("task_id", F.col("created_at").alias("ts"), F.lit(0).alias("kind"), "seq", F.lit(None).cast("string").alias("plan_digest"), p.alias("preview"))
    events = events.unionByName(confirms.select("task_id", "ts", F.lit(1).alias("kind"), "seq", "plan_digest"), allowMissingColumns=True)
    w = Window.partitionBy("task_id").orderBy("ts", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = events.withColumn("last", F.last("preview", ignorenulls=True).over(w)).filter("kind = 1")
    alive = F.when(F.col("last.created_at") >= F.col("ts") - F.expr(f"INTERVAL {minutes} MINUTES"), F.col("last.digest"))
    return d.select("task_id", "seq", confirmation_outcome(F.col("plan_digest"), alive, F.col("last.blockers")).alias("outcome"))


def changed_inputs(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Inputs that vanished or differ in size, time or hash (JN14). Both `(path, size, mtime_ms, sha256)`."""
    c = current.select("path", F.col("size").alias("c_size"), F.col("mtime_ms").alias("c_mtime"), F.col("sha256").alias("c_sha"), F.lit(1).alias("there"))
    d = stored.join(c, "path", "left")
    reason = F.when(F.col("there").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("c_size")), "size").when(~F.col("mtime_ms").eqNullSafe(F.col("c_mtime")), "mtime").when(~F.col("sha256").eqNullSafe(F.col("c_sha")), "sha256")
    return d.withColumn("reason", reason).filter("reason is not null").select("path", "reason")


def duplicates(df: DataFrame, by: list[str]) -> DataFrame:
    """Keys that occur more than once: input ids, paths, output paths of a task (AG16)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def diagnostic_summary(log: DataFrame, detail_id: Column, now: Column, days: int = 7) -> DataFrame:
    """Retained events of one detail id."""
    return log.filter((F.col("timestamp") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("timestamp") <= now) & (F.col("detailId") == detail_id))
