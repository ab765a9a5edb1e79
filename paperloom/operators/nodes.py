"""Ordered document nodes: construction, headings, reading order, document gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import ordered_fold
from ..functions.text import js_trim
from ..functions.vocab import NUMBERING, PDF_NUMBERING, PDF_SECTION, SECTION_SUFFIX


def text_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of a text table as paragraph nodes in order (SRC6, W2). Null texts give no nodes."""
    lines = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "text"))
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat(F.lit("p-"), F.col("pos")).alias("node_id"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), "text")


def make_node(nodes: DataFrame) -> DataFrame:
    """Excerpt, stored text and digest of the untruncated text (FLT1)."""
    return nodes.withColumns({"excerpt": F.substring(js_trim(F.col("text")), 1, 1000), "digest": F.sha2("text", 256), "text": F.substring("text", 1, 10_000)})


def ordinals(df: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """The n-th of its kind, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def outline_levels(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """Heading level from the paragraph's own outline, its style's name or outline, or a legacy style id (FLT2).

    `nodes(doc_id, style_id, outline, ...)`, `styles(doc_id, style_id, name, outline)`.
    """
    name = js_trim(F.coalesce("name", F.lit("")))
    named = F.regexp_extract(name, "(?iu)^(?:heading|标题)\\s*([1-9])\\z", 1)
    own = F.when(F.col("s_outline").between(0, 8), F.col("s_outline") + 1)
    style = F.when(named != "", named.cast("int")).when(name.rlike("(?iu)^(?:title|标题)\\z"), F.lit(1)).otherwise(own)
    legacy = F.regexp_extract(F.coalesce("style_id", F.lit("")), "(?iu)(?:heading|title)(\\d+)", 1)
    s = styles.select("doc_id", "style_id", "name", F.col("outline").alias("s_outline"))
    direct = F.when(F.col("outline").between(0, 8), F.col("outline") + 1)
    level = F.coalesce(direct, style, F.when(legacy != "", F.least(F.lit(9), legacy.cast("int"))))
    return nodes.join(s, ["doc_id", "style_id"], "left").withColumn("level", level.cast("int")).drop("name", "s_outline")


def numbering_level(text: Column, pattern: str, most: int) -> Column:
    """Depth of a numbering prefix: its dots plus one; null without a prefix."""
    prefix = F.regexp_extract(text, pattern, 0)
    return F.when(prefix != "", F.greatest(F.lit(1), F.least(F.lit(most), F.length(prefix) - F.length(F.replace(prefix, F.lit("."), F.lit(""))) + 1)))


def heading_heuristics(nodes: DataFrame) -> DataFrame:
    """Demote headings of odd length; promote numbered paragraphs only in documents left without any heading (FLT3)."""
    n = F.length(js_trim(F.col("text")))
    stays = (F.col("kind") == "heading") & n.between(2, 60)
    value = js_trim(F.col("text"))
    guess = F.coalesce(numbering_level(value, NUMBERING, 9), F.when(value.rlike(SECTION_SUFFIX), F.lit(1)))
    d = nodes.withColumn("_any", F.max(stays.cast("int")).over(Window.partitionBy("doc_id")))
    kind = F.when((F.col("kind") == "heading") & ~stays, F.lit("paragraph")).otherwise(F.col("kind"))
    d = d.withColumn("_kind", kind)
    up = (F.col("_any") == 0) & (F.col("_kind") == "paragraph") & n.between(2, 60) & guess.isNotNull()
    return d.withColumn("level", F.when(up, guess).when(F.col("_kind") == "heading", F.col("level"))).withColumn("kind", F.when(up, F.lit("heading")).otherwise(F.col("_kind"))).drop("_any", "_kind")


def pdf_heading_level(items: DataFrame) -> DataFrame:
    """Heading level of a text item: section words, numbering, or a font of 18 or more (FLT4)."""
    numbered = numbering_level(F.col("text"), PDF_NUMBERING, 6)
    level = F.when(F.length("text") > 160, F.lit(None)).when(F.col("text").rlike(PDF_SECTION), F.lit(1)).otherwise(F.coalesce(numbered, F.when(F.abs("font_size") >= 18, F.lit(1))))
    return items.withColumn("level", level.cast("int"))


def reading_order(items: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Line and index of positioned items: a new line where y drops by more than the tolerance, then left to right.

    The same order as a pairwise comparison with that tolerance wherever lines are further apart than their own jitter.
    """
    page = Window.partitionBy("doc_id", "page")
    down = page.orderBy(F.desc("y"), "ord")
    drop = F.lag("y").over(down) - F.col("y") > tolerance
    d = items.withColumn("_new", F.coalesce(drop.cast("int"), F.lit(0)))
    d = d.withColumn("line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("idx", F.row_number().over(page.orderBy("line", "x", "ord")) - 1).drop("_new")


def textitem_nodes(items: DataFrame) -> DataFrame:
    """Page-anchored nodes of positioned text items, blank ones skipped (SRC4)."""
    full = items.filter(js_trim(F.col("text")) != "")
    d = pdf_heading_level(reading_order(full))
    box = F.struct(F.col("x").alias("x"), F.col("y").alias("y"), F.col("width").alias("width"), F.col("height").alias("height"))
    return d.select("doc_id", "page", "idx", F.concat_ws("-", F.lit("page"), "page", "idx").alias("node_id"), F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph").alias("kind"), "level", js_trim(F.col("text")).alias("text"), box.alias("bbox"))


def layout_pairs(items: DataFrame, gap: float = 48.0) -> DataFrame:
    """Neighbouring items of one baseline with a column gap become two-cell rows; `pair` numbers the blocks.

    Needs `idx` (reading order). A block holds two cells, so a third linked item starts the next one.
    """
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    py, ph, pr = F.lag("y").over(w), F.lag("height").over(w), F.lag(F.col("x") + F.col("width")).over(w)
    linked = (F.abs(F.col("y") - py) <= F.greatest(F.lit(4.0), F.least(F.col("height"), ph) / 2)) & (F.col("x") - pr >= gap)
    d = items.withColumn("_new", (~F.coalesce(linked, F.lit(False))).cast("int"))
    d = d.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rn = F.row_number().over(Window.partitionBy("doc_id", "page", "island").orderBy("idx"))
    return d.withColumn("pair", F.floor((rn - 1) / 2).cast("int")).withColumn("cell", ((rn - 1) % 2).cast("int")).drop("_new")


def document_text(nodes: DataFrame) -> DataFrame:
    """Joined text, its length in nodes' characters and the number of nodes per document (AG8)."""
    d = ordered_fold(nodes, ["doc_id"], ["pos"], F.col("text"), "text", separator="\n")
    length = F.when(F.col("used") > 0, F.length("text") - F.col("used") + 1)  # without the line ends between nodes
    return d.select("doc_id", "text", length.alias("text_length"), F.col("n").alias("n_nodes"))


def text_layer_gate(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id and error_code: no text layer, too large, or null (AG9)."""
    n = nodes.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"))
    chars, count = F.coalesce("chars", F.lit(0)), F.coalesce("n", F.lit(0))
    code = F.when((count == 0) | (chars < 8), F.lit("TEXT_LAYER_REQUIRED")).when((chars > 5_000_000) | (count >= 100_000), F.lit("FILE_TOO_LARGE"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", code.alias("error_code"))
