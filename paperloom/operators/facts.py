"""Labelled facts of documents with exact anchors (T2) and the requirement ledger (AG7)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage
from ..functions.text import fold_text, normalize_text
from ..functions.vocab import FACT_LABELS, FACT_NAME, FACT_VALUES, WS

_ANY = "|".join(x for v in FACT_LABELS.values() for x in v)
#: A node that ends within what stands before a value: the value may be in a later node.
_OPEN_END = f"(?iu)(?:{_ANY}){WS}*(?:{'|'.join(FACT_NAME.values())})?{WS}*(?:为|[：:])?{WS}*\\z"
#: What such a node can end with: the last character of a label, of the word behind it or of a separator, or white space.
_LAST = sorted({x[-1] for v in FACT_LABELS.values() for x in v} | {x[-1] for x in FACT_NAME.values()} | set("为：:") | {chr(c) for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)})
#: Texts whose facts a task remembers.
MEMO = 50_000
#: Characters of a joined text in one bucket of the join of facts with nodes.
BUCKET = 4096


def fact_pattern(kind: str) -> str:
    """Label, optional 名称 for bidders, 为 or a colon, and the value as the last group."""
    name = FACT_NAME.get(kind, "")
    return f"(?iu)(?:{'|'.join(FACT_LABELS[kind])}){WS}*{f'(?:{name}{WS}*)?' if name else ''}(?:为{WS}*|[：:]){WS}*({FACT_VALUES.get(kind, FACT_VALUES['other'])})"


def _matches(text: Column, kind: str) -> Column:
    """begin (from 0), value and k of each match in a text. A match is the first place of its own string behind the match before it."""
    pattern = fact_pattern(kind)

    def add(done: Column, hit: Column) -> Column:
        at = F.position(hit, text, done["next"])
        raw = F.regexp_extract(hit, pattern, 1)
        cut = F.regexp_replace(raw, f"^{WS}+", "")
        begin = at + F.position(raw, hit) - 2 + F.length(raw) - F.length(cut)
        found = F.struct(begin.alias("begin"), F.regexp_replace(cut, f"{WS}+\\z", "").alias("value"), F.size(done["found"]).alias("k"))
        return F.struct((at + F.length(hit)).alias("next"), F.concat(done["found"], F.array(found)).alias("found"))

    none = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<begin:int,value:string,k:int>>").alias("found"))
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), 0), none, add, lambda done: done["found"])


def _holds(text: Column, kinds: Iterable[str]) -> Column:
    """The text holds a label of one of the kinds (labels have no case): a plain search before any pattern."""
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for k in kinds for x in FACT_LABELS[k]])


def _hits(d: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per match of any kind in `text`: kind, begin, value, k."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(_holds(F.col(text), [k]), _matches(F.col(text), k)).alias("found")) for k in FACT_LABELS])
    hits = d.select(*keep, F.explode(kinds).alias("x")).select(*keep, "x.kind", F.explode("x.found").alias("f"))
    return hits.select(*keep, "kind", "f.*").filter("value <> ''")


def _over_nodes(n: DataFrame) -> DataFrame:
    """Facts of documents whose nodes are not whole alone: patterns over the joined text, places joined back to nodes."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    hits = _hits(n.groupBy("doc_id").agg(rows.alias("whole")), "whole", "doc_id").withColumn("bucket", F.floor(F.col("begin") / BUCKET))
    spans = F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("start") + F.length("text")) / BUCKET))
    d = hits.join(n.withColumn("bucket", F.explode(spans)), ["doc_id", "bucket"]).withColumn("inside", F.col("begin") - F.col("start"))
    d = d.filter((F.col("inside") >= 0) & (F.col("inside") <= F.length("text")))
    d = d.filter(F.substring("text", F.col("inside") + 1, F.length("value")) == F.col("value"))
    d = normalize_text(d.withColumn("inside", F.col("inside").cast("int")), "value", "normalized")
    return d.select("doc_id", F.lit(0).cast("long").alias("place"), "node_id", "text", "kind", "k", "inside", "value", "normalized")


def _text_facts(patterns: dict[str, re.Pattern], text: str) -> list[tuple]:
    """(kind, k, inside, value, NFKC of the value, excerpt) of each fact within a text, by the rules of `_matches`."""
    out = []
    for kind, pattern in patterns.items():
        after = 0
        for k, m in enumerate(pattern.finditer(text)):
            hit = m[0]
            at = text.find(hit, after)
            after = at + len(hit)
            raw = pattern.search(hit)[1]
            cut = _LEAD.sub("", raw)
            value = _TAIL.sub("", cut)
            if value:
                inside = at + hit.find(raw) + len(raw) - len(cut)
                begin = max(0, inside - 120)
                out.append((kind, k, inside, value, unicodedata.normalize("NFKC", value), text[begin : begin + 300]))
    return out


_LEAD, _TAIL = re.compile(f"^{WS}+"), re.compile(f"{WS}+\\Z")
_FACT = "place long, node_id string, kind string, k int, inside int, value string, nfkc string, excerpt string"


def node_facts(nodes: DataFrame) -> DataFrame:
    """`doc_id, place, node_id, kind, k, inside, value, normalized, excerpt`: every fact within each of `nodes(doc_id, pos, node_id, text)`.

    Rows are neither shuffled nor joined: labelled lines repeat from document to document, so a task searches a text once for
    as long as it remembers it, and sends back its facts only.
    """
    names = ["doc_id", *[x.split()[0] for x in _FACT.split(", ")]]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {kind: re.compile(fact_pattern(kind).removeprefix("(?iu)"), re.IGNORECASE) for kind in FACT_LABELS}
        known: dict[str, list[tuple]] = {}
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                facts = known.get(text)
                if facts is None:
                    if len(known) >= MEMO:
                        known.clear()
                    facts = known[text] = _text_facts(patterns, text)
                for f in facts:
                    rows.append(i)
                    found.append(f)
            at = pa.array(rows, pa.int64())
            cols = [b.column(0).take(at), b.column(1).take(at), b.column(2).take(at)]
            cols += [pa.array([f[j] for f in found], t) for j, t in enumerate(types[3:])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    labelled = nodes.filter(_holds(F.col("text"), FACT_LABELS)).select(F.col("doc_id").cast("string"), F.col("pos").cast("long"), F.col("node_id").cast("string"), "text")
    d = labelled.mapInArrow(run, f"doc_id string, {_FACT}")
    return d.withColumn("normalized", fold_text(F.col("nfkc"))).drop("nfkc")


def extract_facts(nodes: DataFrame, counted: bool = False) -> DataFrame:
    """All labelled facts over the documents' joined texts; a value may stand in the node after its label.

    `nodes(doc_id, pos, node_id, text)`, read more than once; null texts count as empty. A value ends at its line, so
    nodes are searched one by one, where they are. Only documents with a node that ends before its value are searched as joined
    texts, and the places found there are joined back to the nodes by document and range of characters. A fact counts
    if its value lies in one node; where a match holds its value twice, its first place counts. Such documents are bounded by the text gate.
    Facts are dealt by document, once, for their order within a kind; with `counted`, `of` is their number.
    """
    n = nodes.select("doc_id", "pos", "node_id", F.coalesce("text", F.lit("")).alias("text"))
    unfinished = F.substring("text", -1, 1).isin(*_LAST) & F.col("text").rlike(_OPEN_END)
    across = stage(n.filter(unfinished).select("doc_id").distinct(), "open-documents")
    if across.isEmpty():
        d = node_facts(n)
    else:
        excerpt = F.substring("text", F.greatest(F.lit(0), F.col("inside") - 120) + 1, F.lit(300))
        over = _over_nodes(n.join(across, "doc_id", "left_semi")).withColumn("excerpt", excerpt).drop("text")
        d = node_facts(n.join(across, "doc_id", "left_anti")).unionByName(over)
    order = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("place", "k")) - 1
    d = d.repartition("doc_id").withColumn("ord", order.cast("int"))
    if counted:
        d = d.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "kind")))
    return d.select("doc_id", "kind", "ord", "node_id", "value", "normalized", "excerpt", *["of"] * counted)


def requirement_ledger(facts: DataFrame) -> DataFrame:
    """The first fact of each kind per document: `extract_facts` numbers them from 0, so nothing is grouped."""
    return facts.filter("ord = 0").select("doc_id", "kind", "node_id", "value", "normalized", "excerpt")
