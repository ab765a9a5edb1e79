"""Line dedup by winnowing over line hashes (operator 7), built-in functions only.

Lines with words are hashed to 128 bits (white space at the ends does not count). Of every `window`
consecutive line hashes of a document the smallest is its fingerprint, so two documents that share
`window` lines in a row share a fingerprint at the same place in them. Fingerprints are joined
by value; where one occurs more than once, the match is extended both ways, and every line inside a
run that occurred before (smaller doc_id, then earlier position) is deleted.

A run must be `window` lines long, or a single line of at least `long_words` words:
a repeated long paragraph is a run too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SEP, join_spread, let, stage

WINDOW = 3
LONG_WORDS = 20
#: ASCII white space other than the line feed.
BLANKS = " \t\x0b\x0c\r"


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def line_table(docs: DataFrame, id_col: str, text_col: str, long_words: int) -> DataFrame:
    """doc_id, version (hash of the text) and `h`: number, both halves h and g of the hash and length class of each line with a word."""
    full = F.filter(F.transform(F.split(_text(text_col), "\n", -1), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("t"))), lambda s: s["t"] != "")
    h = F.transform(full, lambda s: F.struct(s["line"].alias("line"), F.xxhash64(s["t"]).alias("h"), F.xxhash64(F.lit(7), s["t"]).alias("g"), (F.size(F.split(s["t"], WORD_SEP + "+", long_words)) >= long_words).alias("long")))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("version"), h.alias("h"))


def fingerprints(lines: DataFrame, window: int) -> DataFrame:
    """doc_id, version, at, fp: the minimum of every `window` consecutive line hashes (rightmost of equal ones), each place once."""

    def pick(h: Column) -> Column:
        lowest = lambda i: F.array_min(F.transform(F.slice(h, i + 1, window), lambda x, j: F.struct(x["h"].alias("h"), (-(i + j)).alias("neg"))))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - window), lowest))

    got = lines.filter(F.size("h") >= window).select("doc_id", "version", F.explode(let(F.col("h"), pick)).alias("c"))
    return got.select("doc_id", "version", (-F.col("c.neg")).alias("at"), F.col("c.h").alias("fp"))


def _runs_around(lines: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """Matches extended both ways: every `window`-line run through a shared fingerprint, with its hash and line numbers."""
    places = shared.groupBy("doc_id", "version").agg(F.collect_set("at").alias("ats"))

    def through(h: Column, ats: Column) -> Column:
        starts = F.array_distinct(F.flatten(F.transform(ats, lambda a: F.sequence(F.greatest(F.lit(0), a - (window - 1)), F.least(a, F.size(h) - window)))))

        def run(i: Column) -> Column:
            part = F.slice(h, i + 1, window)
            half = lambda k: F.xxhash64(F.lit(window), F.transform(part, lambda x: x[k]))
            return F.struct(half("h").alias("run"), half("g").alias("run_g"), i.alias("start"), F.transform(part, lambda x: x["line"]).alias("lines"))

        return F.transform(starts, run)

    got = lines.join(places, ["doc_id", "version"])
    return got.select("doc_id", "version", F.explode(let(F.struct("h", "ats"), lambda s: through(s["h"], s["ats"]))).alias("r")).select("doc_id", "version", "r.*")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, version and the sorted numbers (from 0, over all lines of the text) of the lines to delete.

    Documents that lose nothing are absent. Null text has no lines; rows with a null id are left
    alone. Rows that repeat an id with other texts come in the order of `version`, the hash of the
    text; rows that are equal altogether are one document. Documents of fewer lines than `window` lose long lines only.
    """
    lines = stage(line_table(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, long_words).filter(F.size("h") > 0), "lines")
    prints = fingerprints(lines, window)
    # join positions: fingerprints that occur at more than one place (a count with map-side combine)
    many = stage(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    runs = _runs_around(lines, join_spread(prints, many, "fp", "n", ["doc_id", "at"], "left_semi"), window)
    single = lines.select("doc_id", "version", F.posexplode("h").alias("start", "x")).filter("x.long")
    single = single.select("doc_id", "version", F.xxhash64(F.lit(-1), "x.h").alias("run"), F.xxhash64(F.lit(-1), "x.g").alias("run_g"), "start", F.array("x.line").alias("lines"))
    runs = stage(runs.unionByName(single), "runs")
    place = F.struct("doc_id", "version", "start")
    key = ["run", "run_g"]
    first = stage(runs.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first")
    later = join_spread(runs, first, key, "n", ["doc_id", "start"]).filter(place > F.col("first"))
    return later.select("doc_id", "version", F.explode("lines").alias("k")).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("k")).alias("lines"))


def _without(text: Column, gone: Column) -> Column:
    """`text` without the lines whose numbers are in `gone`."""
    lines = F.split(text, "\n", -1)
    keep = let(F.struct(lines.alias("l"), gone.alias("g")), lambda s: F.struct(s["l"].alias("l"), F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), s["g"]).alias("k")))
    return let(keep, lambda s: F.array_join(F.transform(s["k"], lambda i: F.get(s["l"], i)), "\n"))


def _cut(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (the user's columns as they are), removed_lines and kept_text of every row."""
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(_text(text_col)).alias("version"))
    out = d.join(gone.select("doc_id", "version", F.col("lines").alias("removed_lines")), ["doc_id", "version"], "left")
    text = F.col("row").getField(text_col)
    kept = F.when(F.col("removed_lines").isNull(), text).otherwise(_without(F.coalesce(text.cast("string"), F.lit("")), F.col("removed_lines")))
    return out.select("row", "removed_lines", kept.alias("kept_text"))


def remove_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds `removed_lines` (null where nothing goes) and `kept_text` to all rows; they win over columns of these names, others stay."""
    return _cut(docs.drop("removed_lines", "kept_text"), gone, id_col, text_col).select("row.*", "removed_lines", "kept_text")


def drop_repeated_lines(docs: DataFrame, *, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """`docs` with the repeated runs cut from `text` and `n_chars` brought up to date; columns unchanged, whatever their names.

    A document all of whose words were in repeated runs goes; one that had no words before stays.
    """
    out = _cut(docs, repeated_lines(docs, window=window, long_words=long_words), "doc_id", "text")
    out = out.filter(F.col("removed_lines").isNull() | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        n = F.when(F.col("removed_lines").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text"))
        new["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
