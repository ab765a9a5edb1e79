"""Model responses: parsing and grounding in the text that was sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import JS_WHITE, digest, js_trim
from ..schemas import AI_REVIEW

SEVERITIES = ["error", "warning", "needs-review"]


def parse_ai_review(responses: DataFrame) -> DataFrame:
    """One row per finding; a response that is no JSON or off schema is rejected whole (T12). `responses(pair_id, chunk_index, content)`."""
    body = F.from_json("content", f"{AI_REVIEW}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    d = responses.withColumn("_j", body).filter("_j is not null and _j._corrupt is null and _j.findings is not null")
    ok = F.forall("_j.findings", lambda f: f["severity"].isin(*SEVERITIES) & f["summary"].isNotNull() & f["confidence"].between(0, 1) & f["type"].isNotNull())
    d = d.filter(F.coalesce(ok, F.lit(False)))
    return d.select("pair_id", "chunk_index", F.posexplode("_j.findings").alias("ord", "f")).select("pair_id", "chunk_index", "ord", F.col("f.type"), F.col("f.severity"), F.col("f.confidence"), F.col("f.summary"), F.col("f.suggestion"), F.col("f.tenderEvidence").alias("tender_evidence"), F.col("f.bidEvidence").alias("bid_evidence"))


def parse_ai_fields(responses: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(summary lines, fields): bad entries are dropped one by one, 12 lines and 30 fields at most."""
    v = F.try_parse_json("content")
    d = responses.select(id_col, v.alias("v")).filter("v is not null")
    get = lambda path, t: F.try_variant_get("v", path, t)
    lines = d.select(id_col, F.posexplode(get("$.qualificationSummary", "array<variant>")).alias("ord", "x"))
    lines = lines.filter(F.schema_of_variant("x") == "STRING").select(id_col, "ord", F.substring(js_trim(F.try_variant_get("x", "$", "string")), 1, 300).alias("line")).filter("line <> ''")
    w = Window.partitionBy(id_col).orderBy("ord")
    lines = lines.withColumn("n", F.row_number().over(w)).filter("n <= 12").select(id_col, "n", "line")
    f = d.select(id_col, F.posexplode(get("$.suggestedFields", "array<variant>")).alias("ord", "x"))
    text = lambda p: F.when(F.schema_of_variant(F.try_variant_get("x", p, "variant")) == "STRING", F.try_variant_get("x", p, "string"))
    f = f.select(id_col, "ord", text("$.key").alias("key"), js_trim(text("$.label")).alias("label"))
    f = f.filter(F.col("key").rlike("^[A-Za-z][A-Za-z0-9_-]{0,63}\\z") & (F.length("label") > 0)).withColumn("label", F.substring("label", 1, 100))
    f = f.withColumn("r", F.row_number().over(Window.partitionBy(id_col, "key").orderBy("ord"))).filter("r = 1")
    return lines, f.withColumn("n", F.row_number().over(w)).filter("n <= 30").select(id_col, "n", "key", "label")


def ground_ai(findings: DataFrame | None, evidence: DataFrame, nodes: DataFrame | None, chunks: DataFrame) -> DataFrame:
    """Findings all of whose evidence is real (JN3).

    `evidence(finding_id, doc_id, chunk_index, node_id, digest, excerpt)`: the node must be of the cited document,
    must have been in the chunk, its digest must be that of its text, and the trimmed excerpt must stand
    in the sent and in the stored text. Findings without evidence are dropped. Without `findings` all those are judged
    that have evidence. Without `nodes` each piece of `chunks(doc_id, chunk_index, piece_ord, node_id, text)` is a whole
    node, so that what was sent is what is stored, and passes one shuffle instead of three.
    """
    place = ["doc_id", "chunk_index", "node_id"]
    e = evidence.select("finding_id", *place, "digest", F.btrim("excerpt", F.lit(JS_WHITE)).alias("_x"))
    if nodes is None:
        d = e.join(chunks.select(*place, "text"), place, "left").withColumn("sent", F.col("text"))
    else:
        sent = chunks.groupBy(*place).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_ord", "text"))), lambda x: x["text"]), "\n").alias("sent"))
        d = e.join(nodes.select("doc_id", "node_id", "text"), ["doc_id", "node_id"], "left").join(sent, place, "left")
    ok = (F.col("_x") != "") & F.contains("text", F.col("_x")) & F.contains("sent", F.col("_x")) & (digest(F.col("text")) == F.col("digest"))
    good = d.groupBy("finding_id").agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("ok")).filter("ok and finding_id is not null").select("finding_id")
    return good if findings is None else findings.join(good, "finding_id", "left_semi")
