"""Template sections of tenders: starts, ends, slots, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import action_id, any_field_pattern, field_pattern, js_trim, normalize_text
from ..functions.vocab import BLANK_CELL, EMPTY_SLOT, FORM_FIELDS, TEMPLATE_TITLE, WS

_END = "(?=" + WS + "|\\z|[，,;；])"
_SLOT = "(?iu)(?:^|[|]|" + WS + ")(@)" + WS + "*[：:]" + WS + "*" + EMPTY_SLOT + _END


def _slot(label: str) -> str:
    return _SLOT.replace("@", label)


_FREE_LABEL = "[^\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF：:，,;；|_＿.．·…—–<>\\[\\]【】]{1,30}?"


def template_titles(nodes: DataFrame, document_type: str = "docx") -> DataFrame:
    """Nodes that may start a template section: headings of a DOCX, any node of a PDF (FLT5)."""
    hit = F.col("text").rlike(TEMPLATE_TITLE)
    return nodes.filter(hit if document_type == "pdf" else hit & (F.col("kind") == "heading"))


def section_ends(nodes: DataFrame) -> DataFrame:
    """For each heading the place of the next one of the same or a higher rank; null without one (JN5).

    One running minimum per level over the document's headings from the last to the first; levels are 1 to 9.
    """
    h = nodes.filter("kind = 'heading' and level is not null").select("doc_id", "pos", F.greatest(F.lit(1), F.least(F.lit(9), "level")).alias("rank"))
    below = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.array(*[F.min(F.when(F.col("rank") <= k, F.col("pos"))).over(below) for k in range(1, 10)])
    return h.withColumn("nearest", nearest).select("doc_id", "pos", F.element_at("nearest", F.col("rank")).alias("next_pos"))


def candidates(nodes: DataFrame) -> DataFrame:
    """Candidate ranges (T17, FLT5, JN5, W8): up to the next heading of the same rank if more than two nodes
    there hold text, else to the last body node; one per range."""
    blank = js_trim(F.col("text")) == ""
    body = ~F.col("kind").isin("header", "footer")
    n = nodes.withColumn("_filled", (~blank).cast("int"))
    n = n.withColumn("cum", F.sum("_filled").over(Window.partitionBy("doc_id").orderBy("pos")))
    last = nodes.filter(body).groupBy("doc_id").agg(F.max("pos").alias("last_pos"))
    at = n.select("doc_id", "pos", "cum")
    s = template_titles(n).select("doc_id", "pos", "node_id", "text", "level", (F.col("cum") - F.col("_filled")).alias("before"))
    s = s.join(section_ends(nodes), ["doc_id", "pos"], "left").join(last, "doc_id")
    upto = lambda c, name: at.select("doc_id", F.col("pos").alias(c), F.col("cum").alias(name))
    s = s.withColumn("tight_pos", F.col("next_pos") - 1).join(upto("tight_pos", "tight_cum"), ["doc_id", "tight_pos"], "left").join(upto("last_pos", "last_cum"), ["doc_id", "last_pos"])
    tight = F.col("next_pos").isNotNull() & (F.col("tight_cum") - F.col("before") > 2)
    loose = (F.col("last_pos") > F.col("pos")) & (F.col("last_cum") - F.col("before") >= 2)
    s = s.withColumn("range_kind", F.when(tight, "tight").when(loose, "loose")).filter("range_kind is not null")
    s = s.withColumn("end_pos", F.when(F.col("range_kind") == "tight", F.col("tight_pos")).otherwise(F.col("last_pos")))
    ends = nodes.select("doc_id", F.col("pos").alias("end_pos"), F.col("node_id").alias("end_node_id"))
    s = s.join(ends, ["doc_id", "end_pos"])
    first = F.row_number().over(Window.partitionBy("doc_id", "node_id", "end_node_id").orderBy("pos"))
    s = s.withColumn("_r", first).filter("_r = 1")
    return s.select(
        "doc_id", action_id(F.col("node_id"), F.col("end_node_id")).alias("candidate_id"), F.substring(js_trim(F.col("text")), 1, 300).alias("title"),
        F.col("pos").alias("start_pos"), "end_pos", F.col("node_id").alias("start_node_id"), "end_node_id", "range_kind",
        F.when(F.col("range_kind") == "tight", 0.93).otherwise(0.66).alias("confidence"),
    )


#: A segment of one level holds as many of the level below; five levels cover a document of 2 ** 20 nodes.
FAN_BITS, LEVELS = 4, 5


def range_segments(start: Column, end: Column) -> Column:
    """The range of places as whole segments (level, number): at each level the few at its two edges that fill no segment of the next.

    The highest level takes all that is left, so ranges of any length are covered.
    """
    fan, parts = 1 << FAN_BITS, []
    lo, hi = start, end + 1  # in segments of the level, end excluded
    for level in range(LEVELS):
        seg = lambda a, b, level=level: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: F.struct(F.lit(level).alias("level"), x.cast("long").alias("segment")))).otherwise(F.array())
        if level == LEVELS - 1:
            parts.append(seg(lo, hi))
            break
        up, down = F.least(hi, F.ceil(lo / fan) * fan), F.floor(hi / fan) * fan
        parts += [seg(lo, up), seg(F.greatest(up, down), hi)]
        lo, hi = F.ceil(lo / fan), F.floor(hi / fan)
    return F.concat(*parts)


def candidate_nodes(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes between start and end of each candidate (JN4).

    Ranges are cut into segments of 1, 16, 256 and more places, and nodes meet them by document, level and
    segment: every pair of the join is a row of the result, however many candidates overlap in a document.
    """
    c = cands.filter("start_pos <= end_pos").select("doc_id", "candidate_id", F.explode(range_segments(F.col("start_pos").cast("long"), F.col("end_pos").cast("long"))).alias("_s"))
    c = c.select("doc_id", "candidate_id", F.col("_s.level").alias("_level"), F.col("_s.segment").alias("_segment"))
    # a node is sent only to the levels that its document's ranges use
    used = c.groupBy("doc_id").agg(F.collect_set("_level").alias("_levels"))
    n = nodes.join(used, "doc_id").withColumn("_level", F.explode("_levels")).drop("_levels")
    n = n.withColumn("_segment", F.expr(f"shiftright(CAST(pos AS BIGINT), {FAN_BITS} * _level)"))
    return n.join(c, ["doc_id", "_level", "_segment"]).drop("_level", "_segment")


def cell_place(c: Column) -> Column:
    """Table, row and column of a cell id; nulls for other ids."""
    part = lambda i: F.when(c.rlike("^cell-\\d+-\\d+-\\d+\\z"), F.split(c, "-")[i].cast("int"))
    return F.struct(part(1).alias("t"), part(2).alias("r"), part(3).alias("c"))


def adjacent_cells(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Label cells with the blank cell to their right: keys, node_id, value_node_id (JN7)."""
    by = by or ["doc_id"]
    cells = nodes.filter("kind = 'cell'").withColumn("_p", cell_place(F.col("node_id"))).select(*by, "node_id", "text", "_p.*").filter("t is not null")
    right = cells.filter(F.col("text").rlike(BLANK_CELL)).select(*by, "t", "r", (F.col("c") - 1).alias("c"), F.col("node_id").alias("value_node_id"))
    return cells.join(right, [*by, "t", "r", "c"]).select(*by, "node_id", "text", "value_node_id")


def known_label(c: Column) -> Column:
    """The whole label is one of the fixed vocabulary (FLT9)."""
    return js_trim(c).rlike("(?iu)^(?:" + any_field_pattern() + ")\\z")


def form_slot(c: Column, field: str, trimmed: bool = False) -> Column:
    """Node is exactly a label of the field, or holds label：<empty slot> (FLT8)."""
    text = c if trimmed else js_trim(c)
    return text.rlike("(?iu)^(?:" + field_pattern(field) + ")\\z") | text.rlike(_slot("?:" + field_pattern(field)))


def form_slots(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """`nodes` with `field`: a row for each field of which the node is a slot (FLT8).

    A slot is a label alone or has a colon, so most nodes are left out before the patterns of any field are tried.
    """
    label = any_field_pattern()
    alone = F.col("text").rlike(f"(?iu)^{WS}*(?:{label}){WS}*\\z")
    colon = (F.contains("text", F.lit(":")) | F.contains("text", F.lit("："))) & F.col("text").rlike("(?iu)" + label)
    d = nodes.filter(colon | alone).withColumn("_t", js_trim(F.col("text")))
    flags = F.array_compact(F.array(*[F.when(form_slot(F.col("_t"), f, trimmed=True), F.lit(f)) for f in fields]))
    return d.withColumn("field", F.explode(flags)).drop("_t")


def detected_slots(cands: DataFrame, nodes: DataFrame, most: int = 30) -> DataFrame:
    """Labels with an empty slot that no fixed field owns, per candidate in order: doc_id, candidate_id, label, n (T4)."""
    n = candidate_nodes(cands, nodes.filter("kind <> 'table'"))
    marked = n.withColumn("_ls", F.regexp_extract_all("text", F.lit(_slot(_FREE_LABEL)), 1)).filter(F.size("_ls") > 0)
    inline = marked.select("doc_id", "candidate_id", "pos", F.posexplode("_ls").alias("k", "label"))
    label_cells = n.filter((F.col("kind") == "cell") & (js_trim(F.col("text")) != "") & ~F.col("text").rlike("[：:]"))
    blank = adjacent_cells(n, ["doc_id", "candidate_id"]).select("doc_id", "candidate_id", "node_id")
    cells = label_cells.join(blank, ["doc_id", "candidate_id", "node_id"], "left_semi").select("doc_id", "candidate_id", "pos", F.lit(1_000_000).alias("k"), F.col("text").alias("label"))
    found = inline.unionByName(cells).withColumn("label", js_trim(F.col("label"))).filter((F.length("label") <= 30) & (F.col("label") != "") & ~known_label(F.col("label")))
    found = normalize_text(found, "label", "key").filter("key <> ''")
    first = F.row_number().over(Window.partitionBy("doc_id", "candidate_id", "key").orderBy("pos", "k"))
    found = found.withColumn("_r", first).filter("_r = 1")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "candidate_id").orderBy("pos", "k"))).filter(F.col("n") <= most).select("doc_id", "candidate_id", "label", "n")


def fillable_slots(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """Slots per candidate: detected labels and known fields with a slot node (AG17)."""
    extra = detected_slots(cands, nodes).groupBy("doc_id", "candidate_id").agg(F.count(F.lit(1)).alias("extra"))
    flags = [F.max(form_slot(F.col("text"), f).cast("int")) for f in FORM_FIELDS]
    known = candidate_nodes(cands, nodes.filter("kind <> 'table'")).groupBy("doc_id", "candidate_id").agg(sum(flags[1:], flags[0]).alias("known"))
    d = cands.join(known, ["doc_id", "candidate_id"], "left").join(extra, ["doc_id", "candidate_id"], "left")
    return d.withColumn("fillable_slots", (F.coalesce("known", F.lit(0)) + F.coalesce("extra", F.lit(0))).cast("int")).drop("known", "extra")


def prune_contained(cands: DataFrame) -> DataFrame:
    """Drop a candidate inside another one with strictly more slots (JN6).

    "More slots" is parted by the bits of the slots' rank in their document: of two ranks the larger is the one
    with a one where they first differ. So for each bit, among ranks equal above it, one sweep over the starts
    carries the furthest end of those with a one past those with a zero. No pairs of candidates are made.
    """
    span = ["doc_id", "start_pos", "end_pos", "fillable_slots"]
    d = cands.select(*span).filter("fillable_slots is not null").distinct()
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("fillable_slots")) - 1
    d = d.withColumn("_rank", rank).withColumn("_most", F.max("_rank").over(Window.partitionBy("doc_id"))).filter("_most > 0")
    d = d.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.floor(F.log2("_most")).cast("int"))))
    one = F.expr("shiftright(_rank, _bit) & 1") == 1
    sweep = Window.partitionBy("doc_id", "_bit", F.expr("shiftright(_rank, _bit + 1)")).orderBy("start_pos").rangeBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_one", one).withColumn("_reach", F.max(F.when(F.col("_one"), F.col("end_pos"))).over(sweep))
    inside = d.filter(~F.col("_one") & (F.col("_reach") >= F.col("end_pos"))).select(*span).distinct()
    return cands.join(inside, span, "left_anti").select(*cands.columns)


def rank_candidates(cands: DataFrame, most: int = 50) -> DataFrame:
    """Most slots first, then place; `most` per document (TK1)."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("fillable_slots"), "start_pos")
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def candidate_preview(cands: DataFrame, nodes: DataFrame) -> DataFrame:
    """First five texts (1000 characters at most) and the heading outline of each candidate (TK3)."""
    n = candidate_nodes(cands, nodes).withColumn("t", js_trim(F.col("text"))).filter("t <> ''")
    w = Window.partitionBy("doc_id", "candidate_id")
    n = n.withColumn("r", F.row_number().over(w.orderBy("pos")))
    n = n.withColumn("h", F.when(F.col("kind") == "heading", F.sum((F.col("kind") == "heading").cast("int")).over(w.orderBy("pos"))))
    pick = lambda c: F.sort_array(F.collect_list(F.when(c, F.struct("pos", "t"))))
    d = n.filter("r <= 5 or h <= 100").groupBy("doc_id", "candidate_id").agg(pick(F.col("r") <= 5).alias("five"), pick(F.col("h") <= 100).alias("heads"))
    return d.select("doc_id", "candidate_id", F.substring(F.array_join("five.t", " ｜ "), 1, 1000).alias("preview_text"), F.transform("heads", lambda x: F.substring(x["t"], 1, 200)).alias("section_outline"))


def find_candidates(nodes: DataFrame) -> DataFrame:
    """Ranked and pruned candidates with their slots."""
    return rank_candidates(prune_contained(fillable_slots(candidates(nodes), nodes)))
