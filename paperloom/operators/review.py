"""Rules that compare a tender with a bid. Every rule returns findings without ids; `finish` completes them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bitmap import may_contain
from ..functions.minimisers import index_keys, index_texts
from ..functions.staging import stage
from ..functions.text import digest, normalize_text
from ..functions.vocab import COMPARED, PLACEHOLDER, REQUIRED
from ..schemas import ANCHOR
from .facts import requirement_ledger

MAX_ANCHORS = 10
#: Up to so many bids their nodes are spread over an index; more bids are themselves spread over the tasks.
FEW_BIDS = 1_000


def anchor(document: str, node_id: Column, label: Column, excerpt: Column) -> Column:
    return F.struct(F.lit(document).alias("document"), node_id.alias("nodeId"), label.alias("label"), F.substring(excerpt, 1, 1000).alias("excerpt"))


def none() -> Column:
    return F.array().cast(f"array<{ANCHOR}>")


def _finding(df: DataFrame, ord_: int | Column, type_: str | Column, severity: str | Column, summary: Column, tender: Column, bid: Column, suggestion: str) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("pair_id", lit(ord_).cast("int").alias("ord"), lit(type_).alias("type"), lit(severity).alias("severity"), summary.alias("summary"), tender.alias("tender_evidence"), bid.alias("bid_evidence"), F.lit(suggestion).alias("suggestion"))


def _sided(pairs: DataFrame, rows: DataFrame, side: str, prefix: str) -> DataFrame:
    """Rows of one document of each pair, other columns with a prefix.

    Both sides grow with the input, and a packed file tells little of its rows (pairs in order take about two bytes each,
    and 135 when broadcast), so neither goes through the driver.
    """
    r = rows.select(F.col("doc_id").alias(f"{side}_id"), *[F.col(c).alias(prefix + c) for c in rows.columns if c != "doc_id"])
    return pairs.hint("merge").join(r, f"{side}_id")


def fixed_mismatch(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """First tender value against first bid value of each compared kind (JN1); a missing side is no finding.

    A document's first facts pass as one row. Both sides read the same exchange by document, so facts that were not staged are
    worked out and dealt once; only the tenders' rows go on to their bids.
    """
    first = requirement_ledger(facts).filter(F.col("kind").isin(*COMPARED))
    of = lambda k: F.max(F.when(F.col("kind") == k, F.struct("kind", "node_id", "value", "normalized", "excerpt")))
    first = first.groupBy("doc_id").agg(F.array_compact(F.array(*map(of, COMPARED))).alias("first"))  # in the order that numbered them, sorted once
    d = _sided(pairs, first, "tender", "t_").join(first.select(F.col("doc_id").alias("bid_id"), F.col("first").alias("b_first")).hint("merge"), "bid_id")
    both = F.transform("t_first", lambda t: F.struct(t.alias("t"), F.get(F.filter("b_first", lambda b: b["kind"] == t["kind"]), F.lit(0)).alias("b")))
    d = d.select("pair_id", F.explode(F.filter(both, lambda x: x["t"]["normalized"] != x["b"]["normalized"])).alias("x"))
    d = d.select("pair_id", F.col("x.t.kind").alias("kind"), *[F.col(f"x.{side}.{c}").alias(f"{side}_{c}") for side in "tb" for c in ("node_id", "value", "excerpt")])
    names = F.create_map(*[F.lit(x) for kv in COMPARED.items() for x in kv])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(COMPARED) for x in (k, i)])
    label = names[F.col("kind")]
    number = F.col("kind") == "project_number"  # its anchors quote the value, the others the excerpt
    summary = F.concat(label, F.lit("不一致：招标文件为“"), "t_value", F.lit("”，投标文件为“"), "b_value", F.lit("”。"))
    type_ = F.when(F.col("kind").isin("project_number", "project_name", "section_name"), "project-mismatch").otherwise("fixed-parameter-mismatch")
    quote = lambda p: F.when(number, F.col(p + "value")).otherwise(F.col(p + "excerpt"))
    return _finding(d, order[F.col("kind")] + 10, type_, "error", summary, F.array(anchor("tender", F.col("t_node_id"), label, quote("t_"))), F.array(anchor("bid", F.col("b_node_id"), label, quote("b_"))), "请核对招标文件的固定参数。")


def distinct_values(pairs: DataFrame, facts: DataFrame, kinds: list[str], side: str = "bid") -> DataFrame:
    """pair_id, kind, normalized, first place, and the last spelling with its anchor: first place, last value wins."""
    d = _sided(pairs, facts.filter(F.col("kind").isin(*kinds)), side, "")
    last = F.max_by(F.struct("value", "node_id", "excerpt"), "ord")
    return d.groupBy("pair_id", "kind", "normalized").agg(F.min("ord").alias("place"), last.alias("x")).select("pair_id", "kind", "normalized", "place", "x.*")


def bidder_names(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Bids that name more than one bidder, the confirmed name included (AG4)."""
    confirmed = normalize_text(pairs.select("pair_id", F.col("bidder_name").alias("value")), "value", "normalized")
    named = _sided(pairs, facts.filter("kind = 'bidder_name'"), "bid", "")
    values = named.select("pair_id", "normalized", "value", "ord").unionByName(confirmed.select("pair_id", "normalized", "value", F.lit(2**31 - 1).alias("ord")))
    names = values.groupBy("pair_id", "normalized").agg(F.min("ord").alias("place"), F.max_by("value", "ord").alias("value"))
    many = names.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "、").alias("names")).filter("n > 1")
    w = Window.partitionBy("pair_id").orderBy("ord")
    first = named.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= MAX_ANCHORS)
    own = first.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("ord", anchor("bid", F.col("node_id"), F.col("value"), F.col("excerpt")).alias("a")))).alias("own"))
    tender = _sided(pairs, requirement_ledger(facts.filter("kind = 'bidder_name'")), "tender", "t_").select("pair_id", "t_node_id", "t_excerpt")
    d = many.join(own, "pair_id", "left").join(tender, "pair_id", "left")
    t = F.when(F.col("t_node_id").isNotNull(), F.array(anchor("tender", F.col("t_node_id"), F.lit("招标文件主体"), F.col("t_excerpt")))).otherwise(none())
    severity = F.when(F.col("t_node_id").isNotNull(), "error").otherwise("needs-review")
    return _finding(d, 0, "multiple-bidder-names", severity, F.concat(F.lit("投标文件中发现多个投标单位名称："), "names"), t, F.coalesce(F.col("own.a"), none()), "请统一投标主体名称。")


def internal_conflicts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Kinds of which a bid holds at least two different values (AG5); the first five are evidence."""
    if "of" in facts.columns:  # a fact alone of its kind conflicts with nothing and is not shuffled
        facts = facts.filter("of > 1")
    v = distinct_values(pairs, facts, list(COMPARED))
    names = F.create_map(*[F.lit(x) for kv in COMPARED.items() for x in kv])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(COMPARED) for x in (k, i)])
    label = names[F.col("kind")]
    rows = F.sort_array(F.collect_list(F.struct("place", "value", anchor("bid", F.col("node_id"), label, F.col("excerpt")).alias("a"))))
    d = v.groupBy("pair_id", "kind").agg(F.count(F.lit(1)).alias("n"), rows.alias("rows")).filter("n >= 2")
    summary = F.concat(F.lit("投标文件内部的"), label, F.lit("出现多个不同值："), F.array_join("rows.value", "、"), F.lit("。"))
    return _finding(d, order[F.col("kind")] + 30, "internal-conflict", "needs-review", summary, none(), F.slice("rows.a", 1, 5), "请确认投标文件内部应采用的值。")


def role_confusion(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Bids that mention the tenderer's role: one finding each, five anchors at most (AG6)."""
    role = facts.filter("kind = 'role'")
    w = Window.partitionBy("pair_id").orderBy("ord")
    bid = _sided(pairs, role, "bid", "").withColumn("r", F.row_number().over(w)).filter("r <= 5")
    bid = bid.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("ord", anchor("bid", F.col("node_id"), F.lit("疑似招标人字段"), F.col("excerpt")).alias("a")))).alias("rows"))
    tender = _sided(pairs, requirement_ledger(role), "tender", "t_").select("pair_id", "t_node_id", "t_excerpt")
    t = F.when(F.col("t_node_id").isNotNull(), F.array(anchor("tender", F.col("t_node_id"), F.lit("招标人主体"), F.col("t_excerpt")))).otherwise(none())
    return _finding(bid.join(tender, "pair_id", "left"), 20, "role-confusion", "warning", F.lit("投标文件中仍出现招标人主体字段。"), t, F.col("rows.a"), "请确认投标文件中的主体称谓。")


def placeholder_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bid nodes that still hold blanks or sample text (FLT6)."""
    hit = nodes.filter(F.col("text").rlike(PLACEHOLDER)).select("doc_id", "pos", "node_id", "text")
    d = _sided(pairs, hit, "bid", "")
    return _finding(d, F.col("pos") + 100, "template-placeholder", "warning", F.concat(F.lit("投标文件仍包含未替换的内容：“"), F.substring("text", 1, 120), F.lit("”。")), none(), F.array(anchor("bid", F.col("node_id"), F.lit("未替换占位内容"), F.col("text"))), "请补齐或删除占位内容。")


def required_sections(nodes: DataFrame, pattern: str = REQUIRED) -> DataFrame:
    """Nodes that call for qualification, bid letter, price or commitment (FLT7)."""
    return nodes.filter(F.col("text").rlike("(?iu)" + pattern))


def missing_nodes(pairs: DataFrame, required: DataFrame, bid_nodes: DataFrame, prefix: int = 18, most: int | None = 20) -> DataFrame:
    """pair_id and required nodes whose first normalised characters no bid node holds (JN2, TK2).

    Normalised text has no white space, so a key lies within one node. Of many bids each is searched as its nodes
    pass, of few ones the nodes are spread over tasks. No pairs of nodes, and no row longer than a node, however many nodes a bid has.
    """
    need = normalize_text(required.select("doc_id", "pos", "node_id", "text"), "text", "n").withColumn("key", F.substring("n", 1, prefix)).drop("n")
    need = _sided(pairs.select("pair_id", "tender_id", "bid_id"), need, "tender", "")
    texts = normalize_text(bid_nodes.select("doc_id", "text"), "text", "n").select("doc_id", "n")
    if pairs.select(F.approx_count_distinct("bid_id")).first()[0] > FEW_BIDS:
        d = _missing_of_many(need, texts.select("doc_id", F.coalesce("n", F.lit("")).alias("n")))  # any node holds an empty key
    else:
        d = _missing_of_few(need, texts.filter("n is not null"), bid_nodes.select("doc_id").distinct())
    if most is None:
        return d
    return d.withColumn("r", F.row_number().over(Window.partitionBy("pair_id").orderBy("pos"))).filter(F.col("r") <= most).drop("r")


def _missing_of_many(need: DataFrame, texts: DataFrame) -> DataFrame:
    """Of each bid first the keys, then its texts, then the required nodes pass by in one task, which holds only the keys not found yet.

    Each row is shuffled once, to its bid; nothing is staged or gathered.
    """
    last = lambda c, t="string": F.when(F.col("step") == 2, F.col(c).cast(t)).alias(c)
    both = need.withColumn("step", F.explode(F.array(F.lit(0), F.lit(2)))).filter("step = 2 or key is not null")  # normalised once
    rows = both.select(F.col("bid_id").alias("doc_id"), "step", F.col("key").alias("t"), last("pair_id"), last("pos", "long"), last("node_id"), last("text"))
    rows = rows.unionByName(texts.select("doc_id", F.lit(1).alias("step"), F.col("n").alias("t")), allowMissingColumns=True)
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, left = None, {}  # keys not found yet, by length
        for b in batches:
            out = []
            for i, (d, step, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if d != doc:
                    doc, left = d, {}
                if d is None:  # no bid
                    out += [i] if step == 2 else []
                elif step == 0:
                    left.setdefault(len(t), set()).add(t)
                elif step == 1:
                    for size, keys in left.items():
                        if len(keys) <= len(t) - size:
                            keys.difference_update([k for k in keys if k in t])
                        else:
                            keys.difference_update([t[j : j + size] for j in range(len(t) - size + 1)])
                elif t is None or t in left.get(len(t), ()):
                    out.append(i)
            yield b.select(["pair_id", "pos", "node_id", "text"]).take(pa.array(out, pa.int64()))

    return rows.mapInArrow(run, "pair_id string, pos long, node_id string, text string")


def _missing_of_few(d: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes go into an index of sampled windows for the lengths that keys of their bid have; keys meet it by document and
    gram and are verified on the text around the place."""
    d = stage(d, "required")  # normalised once, read three times
    keys = stage(index_keys(d.filter("key <> ''").select(F.col("bid_id").alias("doc_id"), "key").distinct()), "keys")
    sizes = keys.groupBy("doc_id").agg(F.collect_set(F.length("key")).alias("sizes"))
    places = index_texts(texts.join(sizes, "doc_id"))
    mark = F.xxhash64("doc_id", "gram")
    held = may_contain(places.withColumn("mark", mark), keys.select(mark.alias("mark")), "mark").drop("mark")
    held = held.join(keys, ["doc_id", "gram"]).filter(F.contains("context", "key")).select("doc_id", "key").distinct()
    held = held.union(docs.select("doc_id", F.lit("")))  # any node holds an empty key
    return d.join(held.withColumnRenamed("doc_id", "bid_id"), ["bid_id", "key"], "left_anti").select("pair_id", "pos", "node_id", "text")


def missing_response(pairs: DataFrame, tender_nodes: DataFrame, bid_nodes: DataFrame) -> DataFrame:
    d = missing_nodes(pairs, required_sections(tender_nodes), bid_nodes)
    return _finding(d, F.col("pos") + 200_000, "missing-response", "warning", F.concat(F.lit("投标文件可能缺少对应章节：“"), F.substring("text", 1, 120), F.lit("”。")), F.array(anchor("tender", F.col("node_id"), F.lit("招标要求"), F.col("text"))), none(), "请人工确认是否已响应。")


def finish(findings: DataFrame, source: str = "deterministic") -> DataFrame:
    """Id from type, summary and both evidences; confidence, limits, source and status."""
    key = F.concat_ws("|", "type", "summary", F.to_json("tender_evidence"), F.to_json("bid_evidence"))
    return findings.withColumns(
        {
            "id": digest(key, 24),
            "confidence": F.when(F.col("severity") == "error", 0.98).otherwise(0.82),
            "summary": F.substring("summary", 1, 500),
            "source": F.lit(source),
            "status": F.lit("open"),
        }
    )


def deterministic_findings(pairs: DataFrame, tender_nodes: DataFrame, bid_nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """All rules of a pair, one row per id."""
    rules = [bidder_names(pairs, facts), fixed_mismatch(pairs, facts), role_confusion(pairs, facts), internal_conflicts(pairs, facts), placeholder_nodes(pairs, bid_nodes), missing_response(pairs, tender_nodes, bid_nodes)]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return first_per_id(finish(out))


def first_per_id(findings: DataFrame) -> DataFrame:
    w = Window.partitionBy("pair_id", "id").orderBy(F.when(F.col("source") == "deterministic", 0).otherwise(1), "ord")
    return findings.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def merge_findings(rules: DataFrame, ai: DataFrame) -> DataFrame:
    """Union of both sides, one per id, rule side first (SET1)."""
    return first_per_id(rules.unionByName(ai, allowMissingColumns=True))


def filter_findings(findings: DataFrame, severity: str = "all", source: str = "all") -> DataFrame:
    """By severity and source, each or all (FLT16)."""
    if severity != "all":
        findings = findings.filter(F.col("severity") == severity)
    return findings if source == "all" else findings.filter(F.col("source") == source)


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per pair by source (AG3)."""
    n = lambda s: F.count_if(F.col("source") == s)
    return findings.groupBy("pair_id").agg(n("deterministic").alias("deterministic_count"), n("ai").alias("ai_count"), F.count(F.lit(1)).alias("total"))
