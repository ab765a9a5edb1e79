"""Fill plans: which value goes into which node, and what is left blank."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold
from ..functions.staging import stage
from ..functions.text import action_id, any_field_pattern, field_pattern, js_trim, label_pattern, normalize_text
from ..functions.vocab import EMPTY_SLOT, FIELD_SYNONYMS, FIXED_BLANK, FIXED_FIELDS, FORM_FIELDS, IMAGE_MARKER, LEFTOVER, MARKER, PLACEHOLDER_NAMES, SEPARATOR, WS
from .templates import _END, adjacent_cells, candidate_nodes, form_slot

CAND = ["doc_id", "candidate_id"]


def _first_target(hits: DataFrame, fields: DataFrame, by: list[str]) -> DataFrame:
    """First hit of each key in document order, moved to the blank cell beside it; all `by` columns kept."""
    w = Window.partitionBy(*by).orderBy("pos")
    first = hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    beside = adjacent_cells(fields, CAND).select(*CAND, "node_id", "value_node_id")
    return first.join(beside, [*CAND, "node_id"], "left").withColumn("target_node_id", F.coalesce("value_node_id", "node_id")).drop("value_node_id")


def form_targets(cands: DataFrame, nodes: DataFrame, form: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, unresolved) of known form values (JN15). `form(form_id, field, value)`; empty values are skipped.

    `plans(doc_id, candidate_id, form_id)` says which form fills which candidate; nothing else meets.
    """
    fields = candidate_nodes(cands, nodes.filter("kind <> 'table'"))
    flags = F.array_compact(F.array(*[F.when(form_slot(F.col("text"), f), F.lit(f)) for f in FORM_FIELDS]))
    hits = fields.withColumn("field", F.explode(flags))
    target = _first_target(hits, fields, [*CAND, "field"]).select(*CAND, "field", "target_node_id")
    want = cands.select(*CAND).join(plans, CAND).join(form.filter("coalesce(value, '') <> ''").select("form_id", "field", "value"), "form_id")
    d = want.join(target, [*CAND, "field"], "left")
    found = d.filter("target_node_id is not null")
    actions = found.select(*CAND, "form_id", action_id(F.col("field"), F.col("target_node_id"), F.col("value")).alias("field_id"), F.col("field").alias("label"), "target_node_id", F.lit("replace").alias("action"), F.lit("user-form").alias("source"), "value")
    return actions, d.filter("target_node_id is null").select(*CAND, "form_id", "field")


def extra_targets(cands: DataFrame, nodes: DataFrame, extras: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, unresolved) of user-defined labels (JN16). `extras(form_id, key, label, value)`.

    `plans(doc_id, candidate_id, form_id)` as for forms: a candidate's nodes meet the labels of its own form only.
    """
    fields = normalize_text(candidate_nodes(cands, nodes.filter("kind <> 'table'")).filter(js_trim(F.col("text")) != ""), "text", "_n")

    e = normalize_text(extras.filter("coalesce(value, '') <> ''"), "label", "_key").withColumn("_p", slot_pattern(F.col("label"))).filter("_key <> ''")
    slot = F.concat(F.lit("(?iu)(?:^|[|]|" + WS + ")(?:"), F.col("_p"), F.lit(")" + WS + "*[：:]" + WS + "*" + EMPTY_SLOT + _END))
    hits = fields.join(plans, CAND).join(e, "form_id").withColumn("_slot", slot).filter((F.col("_n") == F.col("_key")) | F.expr("text rlike _slot"))
    target = _first_target(hits.select(*CAND, "node_id", "pos", "form_id", "key", "label", "value"), fields, [*CAND, "form_id", "key"])
    actions = target.select(*CAND, "form_id", action_id(F.lit("extra"), F.col("key"), F.col("target_node_id"), F.col("value")).alias("field_id"), "label", "target_node_id", F.lit("replace").alias("action"), F.lit("user-form").alias("source"), "value")
    want = cands.select(*CAND).join(plans, CAND).join(e.select("form_id", "key", "label"), "form_id")
    return actions, want.join(target, [*CAND, "form_id", "key"], "left_anti").select(*CAND, "form_id", F.col("key").alias("field"))


def fixed_targets(cands: DataFrame, nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Tender facts into the first free node of their kind that is not their evidence (JN17).

    Greedy in fact order: the n-th fact of a kind cannot use what earlier ones took. Only facts and nodes
    that match meet in a group, which is a handful of rows.
    """
    fields = candidate_nodes(cands, nodes.filter("kind <> 'table'")).filter(F.col("text").rlike(FIXED_BLANK))
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?iu)" + field_pattern(f)), F.lit(k)) for k, f in FIXED_FIELDS.items()]))
    slots = fields.withColumn("kind", F.explode(kinds)).groupBy(*CAND, "kind").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("slots"))
    own = facts.filter(F.col("kind").isin(*FIXED_FIELDS)).groupBy("doc_id", "kind").agg(F.sort_array(F.collect_list(F.struct("ord", "node_id", "value"))).alias("facts"))

    @F.pandas_udf("array<struct<target:string,value:string,evidence:string>>")
    def place(slots: pd.Series, facts: pd.Series) -> pd.Series:
        out = []
        for s, f in zip(slots, facts, strict=True):
            used, got = set(), []
            for fact in f:
                free = next((x["node_id"] for x in s if x["node_id"] != fact["node_id"] and x["node_id"] not in used), None)
                if free is not None:
                    used.add(free)
                    got.append({"target": free, "value": fact["value"], "evidence": fact["node_id"]})
            out.append(got)
        return pd.Series(out)

    d = slots.join(own, ["doc_id", "kind"]).withColumn("x", F.explode(place("slots", "facts")))
    label = F.create_map(*[F.lit(x) for kv in FIXED_FIELDS.items() for x in kv])[F.col("kind")]
    key = action_id(F.lit("tender-fixed"), label, F.col("x.target"), F.col("x.evidence"), F.col("x.value"))
    return d.select(*CAND, key.alias("field_id"), label.alias("label"), F.col("x.target").alias("target_node_id"), F.lit("replace").alias("action"), F.lit("tender-fixed").alias("source"), F.col("x.value").alias("value"), F.col("x.evidence").alias("evidence_node_id"))


def image_placeholders(nodes: DataFrame) -> DataFrame:
    """One action per image, certificate or signature marker in a node."""
    d = nodes.withColumn("_m", F.regexp_extract_all("text", F.lit("(?iu)" + IMAGE_MARKER), 1)).filter(F.size("_m") > 0)
    keep = [c for c in ("doc_id", "candidate_id", "node_id") if c in nodes.columns]
    d = d.select(*keep, F.posexplode("_m").alias("ord", "label"))
    type_ = F.when(F.contains("label", F.lit("证照")), "certificate").when(F.col("label").rlike("签|章"), "signature").otherwise("image")
    return d.select(*keep, action_id(F.lit("placeholder"), F.col("node_id"), F.col("ord").cast("string")).alias("field_id"), "ord", "label", type_.alias("placeholder_type"))


_LABEL_AHEAD = f"(?:{any_field_pattern()}){WS}*[：:]"
_LABEL_END = f"{WS}*[：:]?{WS}*"
# a value goes on to a separator, to the next label after white space, or, if none follows after white space, to the next label
_VALUE_END = f"(?={SEPARATOR}|{WS}+{_LABEL_AHEAD}|{_LABEL_AHEAD}(?![\\s\\S]*{WS}{_LABEL_AHEAD})|\\z)"


def _literal(c: Column) -> Column:
    """A replacement text in which nothing refers to a group."""
    return F.regexp_replace(c, "([\\\\$])", "\\\\$1")


def slot_pattern(label: Column) -> Column:
    """Pattern of a field's synonyms, or of a free label; null for a label without characters (T5)."""

    @F.pandas_udf("string")
    def free(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else label_pattern(x) or None)

    known = F.create_map(*[F.lit(x) for f in FIELD_SYNONYMS for x in (f, field_pattern(f))])[label]
    return F.coalesce(known, free(label))


def replace_field(text: Column, pattern: Column, value: Column) -> Column:
    """`value` behind the first label: in place of the placeholder there, else of what stands there up to the end of the value.

    Without the label, or without a pattern, the value is the whole text.
    """
    label = F.concat(F.lit("(?iu)(?:"), pattern, F.lit(f"){_LABEL_END}"))
    whole = F.concat(F.lit("(?iu)\\A([\\s\\S]*?(?:"), pattern, F.lit(f"){_LABEL_END})(?:{EMPTY_SLOT}|[\\s\\S]*?{_VALUE_END})"))
    return F.when(F.coalesce(F.rlike(text, label), F.lit(False)), F.regexp_replace(text, whole, F.concat(F.lit("$1"), _literal(value)))).otherwise(value)


def insert_placeholder(text: Column, placeholder_type: Column) -> Column:
    """The first image marker replaced by a request for the image, or that request alone."""
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in PLACEHOLDER_NAMES.items() for x in kv])[F.coalesce(placeholder_type, F.lit("image"))], F.lit(PLACEHOLDER_NAMES["image"]))
    new = F.concat(F.lit("【请插入："), name, F.lit("】"))
    return F.when(text.rlike(MARKER), F.regexp_replace(text, F.lit(f"\\A([\\s\\S]*?){MARKER}"), F.concat(F.lit("$1"), new))).otherwise(new)


def apply_actions(nodes: DataFrame, actions: DataFrame) -> DataFrame:
    """Adds `new_text`: the node's ordered actions folded over its text (T8), all in SQL functions.

    `actions(doc_id, target_node_id, ord, action, label, value, placeholder_type)`.
    """
    value = F.coalesce("value", F.lit(""))
    step = F.struct("ord", "action", "label", value.alias("value"), "placeholder_type", slot_pattern(F.col("label")).alias("pattern"))
    steps = actions.select("doc_id", F.col("target_node_id").alias("node_id"), step.alias("step"))
    per_node = steps.groupBy("doc_id", "node_id").agg(F.sort_array(F.collect_list("step")).alias("steps"))

    def one(text: Column, s: Column) -> Column:
        filled = F.when(js_trim(text) == "", s["value"]).otherwise(replace_field(text, s["pattern"], s["value"]))
        return F.when(s["action"] == "replace", filled).when(s["action"] == "placeholder", insert_placeholder(text, s["placeholder_type"])).otherwise(text)

    d = nodes.join(per_node.withColumnRenamed("steps", "_steps"), ["doc_id", "node_id"], "left")
    folded = F.aggregate("_steps", F.coalesce("text", F.lit("")), one)
    return d.withColumn("new_text", F.when(F.col("_steps").isNull(), F.col("text")).otherwise(folded)).select(*nodes.columns, "new_text")


def leftover_blanks(filled: DataFrame) -> DataFrame:
    """Nodes that still hold blanks after their actions (AG18)."""
    return filled.filter(F.col("new_text").rlike(LEFTOVER)).select(*[c for c in filled.columns if c not in ("text", "new_text")], F.substring("text", 1, 500).alias("text"))


def plan_blockers(unresolved: DataFrame) -> DataFrame:
    """Unresolved fields per plan, and those that block it: the bidder's name (AG18)."""
    return unresolved.groupBy(*CAND, "form_id").agg(F.count_if(F.col("field") == "bidderName").alias("unknown_required"), F.count(F.lit(1)).alias("unresolved"))


def plan_digest(actions: DataFrame, by: list[str], order: str = "field_id") -> DataFrame:
    """sha256 over the ordered JSON of a plan's actions (AG15)."""
    cols = [c for c in actions.columns if c not in by]
    row = F.to_json(F.struct(order, *[c for c in cols if c != order]))
    out = ordered_fold(actions, by, [order, *[c for c in cols if c != order]], row, "plan_digest", separator=",", digest=("[", "]"))
    return out.select(*by, "plan_digest", F.col("n").alias("n_actions"))


def range_leak(cands: DataFrame, nodes: DataFrame, output: DataFrame) -> DataFrame:
    """Body texts of eight characters or more outside the range that the generated text holds (JN18). `output(doc_id, candidate_id, text)`.

    The distinct body texts of a document become one automaton, through which each of its outputs is
    walked once: time follows the texts, not their product. A document's texts (bounded by the text gate) and one output are
    held at a time. The texts found are joined back to the nodes by document and text.
    """
    body = nodes.filter(~F.col("kind").isin("header", "footer")).withColumn("_t", js_trim(F.col("text"))).filter(F.length("_t") >= 8)
    ranges = stage(cands.select(*CAND, "start_pos", "end_pos"), "ranges")
    texts = output.join(ranges.select(*CAND).distinct(), CAND, "left_semi").select("doc_id", "candidate_id", F.col("text").alias("_t"))
    # a document's patterns stand before its outputs
    rows = body.select("doc_id", F.lit(None).cast("string").alias("candidate_id"), "_t").distinct().withColumn("_out", F.lit(False)).unionByName(texts.withColumn("_out", F.lit(True)))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "_out").select("doc_id", "candidate_id", "_t", "_out")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        doc, machine = None, None
        for b in batches:
            found: set[tuple] = set()
            for d, c, t, is_output in zip(*(b.column(k) for k in range(4)), strict=True):
                d, t = d.as_py(), t.as_py()
                if machine is None or d != doc:
                    doc, machine = d, ahocorasick.Automaton()
                if not is_output.as_py():
                    machine.add_word(t, t)
                    continue
                if t and len(machine):
                    if machine.kind != ahocorasick.AHOCORASICK:
                        machine.make_automaton()
                    found |= {(d, c.as_py(), hit) for _, hit in machine.iter(t)}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(3)], names=["doc_id", "candidate_id", "_t"])

    held = rows.mapInArrow(walk, "doc_id string, candidate_id string, _t string").distinct()
    d = held.join(ranges, CAND).join(body.select("doc_id", "pos", "node_id", "_t"), ["doc_id", "_t"])
    return d.filter(~F.col("pos").between(F.col("start_pos"), F.col("end_pos"))).select(*CAND, "node_id")


def text_fidelity(expected: DataFrame, output: DataFrame, by: list[str], order: str = "ord") -> DataFrame:
    """Places where the output's nodes are not the expected ones, one by one (JN19)."""
    e = expected.select(*by, order, F.col("text").alias("expected"))
    o = output.select(*by, order, F.col("text").alias("found"))
    return e.join(o, [*by, order], "full").filter(~F.col("expected").eqNullSafe(F.col("found")))
