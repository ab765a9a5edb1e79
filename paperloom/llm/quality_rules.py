"""Line-first quality rules (operator 4), built-in functions only.

Counts over the whole document come first; then each line is judged on its own,
failing lines are dropped, and a document is rejected if too much text went with them.
Nothing is shuffled: a document is judged inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEP, let

#: Phrases of page furniture, in lower case.
BOILERPLATE = [
    "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "accept cookies",
    "enable javascript", "javascript is disabled", "lorem ipsum", "click here to", "sign up for our", "subscribe to our newsletter",
    "alle rechte vorbehalten", "datenschutzerklärung", "tous droits réservés", "politique de confidentialité",
    "todos los derechos reservados", "política de privacidad",
]
NAV_SEPARATORS = r"[|»›•·→]"
SYMBOLS = r"[#*$%&|<>]"


def _split_words(text: Column) -> Column:
    return F.split(text, WORD_SEP, -1)


def _repeat_words(words: Column, n: int) -> Column:
    """Words inside n-word windows that occur at least twice, first occurrence included."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.slice(w, i + 1, n)))

        def cover(g: Column) -> Column:
            order = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

            def spots(s: Column) -> Column:
                same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
                twice = F.filter(s, lambda x, j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
                return F.sort_array(F.transform(twice, lambda x: x["i"]))

            def total(p: Column) -> Column:
                gap = lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n)))
                return F.aggregate(F.transform(p, gap), F.lit(0).cast("long"), lambda a, x: a + x)

            return let(let(order, spots), total)

        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(cover(g)))

    return F.when(F.size(words) < n + 1, F.lit(0).cast("long")).otherwise(let(words, of))


def line_fails(line: Column) -> Column:
    """True for a line that is no prose: navigation, boilerplate, or punctuation of no sentence.

    Blank lines never fail. The rules: at least 4 navigation separators and one for every 3 words;
    a boilerplate phrase; symbols `#*$%&|<>` in a fifth of its non-space characters or more;
    exclamation or question marks on at least half of 4 or more words.
    """
    chars = F.length(F.regexp_replace(line, WORD_SEP, ""))
    n_words = F.size(F.filter(_split_words(line), lambda w: w != ""))
    count = lambda pattern: F.size(F.split(line, pattern, -1)) - 1
    lower = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(lower, F.lit(phrase))
    nav = count(NAV_SEPARATORS)
    return (chars > 0) & (((nav >= 4) & (nav * 3 >= n_words)) | (count(SYMBOLS) * 5 >= chars) | ((n_words >= 4) & (count(r"[!?]+") * 2 >= n_words)) | boiler)


def clean_lines(docs: DataFrame, text_col: str = "text", *, max_lost: float = 0.5, min_words: int = 20, repeat_window: int = 8, max_repeat_pct: int = 30) -> DataFrame:
    """Adds the counts, `cleaned_text` (failing lines removed), `lost_share`, `base_failed` and `kept`.

    Null text has no words and fails the base rules. All other columns pass through; the added
    names win over equal names in the input. Documents lose a line only by `line_fails`; one is
    rejected if more than `max_lost` of its non-space characters went, or the base rules fail.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned_text", "lost_share", "base_failed", "kept"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added or c == text_col]).alias("row"), text.alias("of_text"), F.split(text, "\n", -1).alias("of_lines"))
    words = F.filter(_split_words(F.col("of_text")), lambda w: w != "")
    counts = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            _repeat_words(w, repeat_window).alias("n_repeat_words"),
        ),
    )
    full = let(
        F.filter("of_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.filter(x, lambda y: ~line_fails(y)).alias("good")),
    )
    d = d.withColumns({"c": counts, "l": full, "n_symbols": (F.size(F.split("of_text", SYMBOLS, -1)) - 1).cast("long")})
    good_chars = F.aggregate(F.col("l.good"), F.lit(0).cast("long"), lambda a, x: a + F.length(F.regexp_replace(x, WORD_SEP, "")))
    d = d.withColumns(
        {
            "n_words": F.col("c.n_words"),
            "word_chars": F.col("c.word_chars"),
            "n_repeat_words": F.col("c.n_repeat_words"),
            "n_dup_lines": F.col("l.n_dup_lines"),
            "cleaned_text": F.array_join("l.good", "\n"),
            "lost_share": F.when(F.col("c.word_chars") > 0, 1 - good_chars / F.col("c.word_chars")).otherwise(F.lit(0.0)),
        }
    )
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    d = d.withColumn("base_failed", base)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost)).select("row.*", *[c for c in added if c != text_col])
