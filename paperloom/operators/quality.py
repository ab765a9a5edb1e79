"""Schema invariants as queries: each returns one row per violation with the rule's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows of `keys` with the name of every rule that holds for them; a rule that is null does not hold."""
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return df.select(*keys, F.explode(hits).alias("rule"))


def check_findings(findings: DataFrame) -> DataFrame:
    """Evidence and limits of findings (Q1)."""
    t, b = F.size("tender_evidence"), F.size("bid_evidence")
    return violations(
        findings,
        ["pair_id", "id"],
        {
            "error-needs-both-sides": (F.col("severity") == "error") & ((t == 0) | (b == 0)),
            "too-many-anchors": (t > 10) | (b > 10),
            "summary-length": ~F.length("summary").between(1, 500),
            "id-length": ~F.length("id").between(1, 100),
            "severity": ~F.col("severity").isin("error", "warning", "needs-review"),
            "source": ~F.col("source").isin("deterministic", "ai"),
        },
    )


def check_nodes(nodes: DataFrame) -> DataFrame:
    """Ids, kinds, levels, texts and digests of nodes (Q2)."""
    return violations(
        nodes,
        ["doc_id", "node_id"],
        {
            "id-pattern": ~F.col("node_id").rlike("^[A-Za-z0-9_-]{1,120}\\z"),
            "kind": ~F.col("kind").isin("paragraph", "heading", "table", "cell", "header", "footer", "page"),
            "level": F.col("level").isNotNull() & ~F.col("level").between(0, 9),
            "text-length": F.length("text") > 10_000,
            "digest": ~F.col("digest").rlike("^[0-9a-f]{64}\\z"),
        },
    )


def check_progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Completed means verified and progress 1; failed means an error code, and the other way round (Q3)."""
    done, failed = F.col("state") == "completed", F.col("state") == "failed"
    return violations(
        events,
        keys,
        {
            "completed-not-verified": done & ~F.coalesce(F.col("verification_status") == "passed", F.lit(False)),
            "completed-progress": done & (F.col("progress") != 1),
            "failed-without-error": failed & F.col("error_code").isNull(),
            "error-without-failure": ~failed & F.col("error_code").isNotNull(),
            "progress-range": ~F.col("progress").between(0, 1),
        },
    )


def check_reports(reports: DataFrame, checks: DataFrame) -> DataFrame:
    """Status against checks and times of reports (Q4). `reports(task_id, status, started_at, completed_at)`, `checks(task_id, doc_id, status)`."""
    c = checks.groupBy("task_id").agg(F.count_distinct("doc_id").alias("files"), F.bool_and(F.col("status") == "passed").alias("passed"))
    d = reports.join(c, "task_id", "left")
    done = F.col("status") == "completed"
    return violations(
        d,
        ["task_id"],
        {
            "completed-without-files": done & (F.coalesce("files", F.lit(0)) == 0),
            "completed-not-passed": done & ~F.coalesce("passed", F.lit(True)),
            "times": F.col("completed_at") < F.col("started_at"),
        },
    )


def check_actions(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence, values and types of fill actions (Q5)."""
    return violations(
        actions,
        keys,
        {
            "fixed-needs-evidence": (F.col("source") == "tender-fixed") & F.col("evidence_node_id").isNull(),
            "form-needs-value": (F.col("source") == "user-form") & (F.coalesce("value", F.lit("")) == ""),
            "placeholder-needs-type": (F.col("action") == "placeholder") & F.col("placeholder_type").isNull(),
            "unknown-has-value": (F.col("source") == "unknown") & F.col("value").isNotNull(),
        },
    )
