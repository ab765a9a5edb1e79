"""Reports: JSON and HTML, one row per pair or task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold
from ..functions.text import action_id, escape_html, normalize_text
from ..functions.vocab import SUMMARY_KINDS, WS

MAX_FINDINGS = 5_000


def review_json(findings: DataFrame, columns: list[str], most: int = MAX_FINDINGS) -> DataFrame:
    """pair_id and one JSON report of its findings in order (SNK1)."""
    w = Window.partitionBy("pair_id").orderBy("ord", "id")
    d = findings.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    d = ordered_fold(d, ["pair_id"], ["_r"], F.to_json(F.struct(*columns)), "rows", separator=",")
    head = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.col("pair_id").alias("taskId")))
    return d.select("pair_id", F.concat(F.left(head, F.length(head) - 1), F.lit(',"findings":['), "rows", F.lit("]}")).alias("report"))


def _cells(*cols: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cols], F.lit("</tr>"))


def render_review_html(findings: DataFrame, most: int = MAX_FINDINGS) -> DataFrame:
    """pair_id and a page with one table row per finding, evidence as a list; all text escaped (SNK2)."""
    item = lambda e: F.concat(F.lit("<li>"), escape_html(e["document"]), F.lit(" / "), escape_html(e["label"]), F.lit(" / "), escape_html(e["nodeId"]), F.lit("："), escape_html(e["excerpt"]), F.lit("</li>"))
    evidence = F.concat(F.lit("<ul>"), F.array_join(F.transform(F.concat("tender_evidence", "bid_evidence"), item), ""), F.lit("</ul>"))
    row = _cells(escape_html(F.col("severity")), escape_html(F.col("source")), F.col("confidence").cast("string"), escape_html(F.col("summary")), escape_html(F.col("suggestion")), evidence)
    d = findings.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy("ord", "id"))).filter(F.col("_r") <= most)
    d = ordered_fold(d, ["pair_id"], ["_r"], row, "body")
    page = F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>对照审查</title><h1>对照审查</h1><table>'), F.col("body"), F.lit("</table>"))
    return d.select("pair_id", page.alias("html"))


def render_rows_html(df: DataFrame, by: str, order: list[str], cols: list[str]) -> DataFrame:
    """One page per key with one escaped table row per input row (SNK2)."""
    row = _cells(*[escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols])
    return ordered_fold(df, [by], order, row, "rows").select(by, F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("html"))


def sanitize_report(fields: DataFrame, warnings: DataFrame, status: DataFrame) -> DataFrame:
    """Per file its fields by outcome, number of warnings and verification (AG19)."""
    outcome = F.when(F.col("action") == "randomize", "changed").when(F.col("action") == "preserve", "preserved").otherwise("warning")
    of = lambda o: F.coalesce(F.sum(F.when(outcome == o, F.col("occurrences"))), F.lit(0))
    f = fields.groupBy("doc_id").agg(of("changed").alias("changed"), of("preserved").alias("preserved"), of("warning").alias("warned"))
    w = warnings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("warnings"))
    return f.join(w, "doc_id", "left").join(status, "doc_id", "left").withColumn("warnings", F.coalesce("warnings", F.lit(0)))


def requirement_summary(facts: DataFrame, most: int = 12) -> DataFrame:
    """Summary lines of a document: kind：value（excerpt）, kinds in fixed order, first of equal values."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(SUMMARY_KINDS) for x in (k, i)])
    name = F.create_map(*[F.lit(x) for kv in SUMMARY_KINDS.items() for x in kv])
    d = facts.filter(F.col("kind").isin(*SUMMARY_KINDS)).withColumn("_k", order[F.col("kind")])
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "kind", "normalized").orderBy("ord"))).filter("_r = 1")
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("_k", "ord"))).filter(F.col("n") <= most)
    quote = F.trim(F.regexp_replace("excerpt", WS + "+", " "))
    return d.select("doc_id", "n", F.substring(F.concat(name[F.col("kind")], F.lit("："), "value", F.lit("（摘自："), quote, F.lit("）")), 1, 300).alias("line"))


def suggested_fields(slots: DataFrame, most: int = 30) -> DataFrame:
    """Distinct slot labels of a document as fields with stable keys (T16, T11). `slots(doc_id, start_pos, n, label)`."""
    d = normalize_text(slots, "label", "_key")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("start_pos", "n"))).filter("_r = 1")
    d = d.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("start_pos", "n"))).filter(F.col("ord") <= most)
    return d.select("doc_id", "ord", F.concat(F.lit("slot-"), action_id(F.col("label"), chars=12)).alias("key"), F.substring("label", 1, 100).alias("label"))
