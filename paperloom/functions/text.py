"""Text functions with the reference semantics: JavaScript white space, end of input, code-point lengths.

Lengths and cuts count code points; the only difference to UTF-16 units is at characters
outside the basic plane that stand at a cut.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import FIELD_SYNONYMS, WS

_WS = re.compile(WS + "+")
#: JavaScript white space as plain characters: `F.btrim` with them returns what `js_trim` does, without a pattern.
JS_WHITE = "".join(c for c in map(chr, range(0x10000)) if _WS.match(c))
#: Full-width forms that NFKC changes one by one to ASCII.
_FULL, _HALF = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def js_trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "^" + WS + "+", ""), WS + "+\\z", "")


def digest(c: Column, chars: int = 64) -> Column:
    return F.substring(F.sha2(c, 256), 1, chars)


def normalize_value(value: str) -> str:
    """NFKC, no white space, half-width parentheses, lower case."""
    v = _WS.sub("", unicodedata.normalize("NFKC", value))
    return v.replace("（", "(").replace("）", ")").lower()


def _nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return nfkc(c)


def fold_text(c: Column) -> Column:
    """What `normalize_text` does after NFKC: no white space, half-width forms (of which NFKC leaves none), lower case."""
    bare = F.regexp_replace(c, WS + "+", "")
    return F.lower(F.when(c.rlike("[\\uFF01-\\uFF5E]"), F.translate(bare, _FULL, _HALF)).otherwise(bare))


def normalize_text(df: DataFrame, col: str, out: str) -> DataFrame:
    """Adds the normalised form of `col` (T1). Only texts with other than ASCII, common ideographs and full-width ASCII go to Python; other rows send a null."""
    odd = F.when(F.col(col).rlike("[^\\x00-\\x7F\\u4E00-\\u9FFF\\uFF01-\\uFF5E]"), F.col(col))
    return df.withColumn(out, fold_text(F.coalesce(_nfkc(odd), F.col(col))))


def escape_html(c: Column) -> Column:
    """& < > \" ' as entities."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def action_id(*parts: Column, chars: int = 24) -> Column:
    """Truncated sha256 of the parts joined by |."""
    return digest(F.concat_ws("|", *parts), chars)


def label_pattern(label: str) -> str:
    """Pattern of a literal label: NFKC, escaped, white space allowed between characters (T5)."""
    chars = [c for c in unicodedata.normalize("NFKC", label) if not _WS.match(c)]
    return (WS + "*").join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", c) for c in chars)


def synonyms_pattern(labels: list[str]) -> str:
    return "|".join(label_pattern(x) for x in sorted(labels, key=len, reverse=True))


def field_pattern(field: str) -> str:
    return synonyms_pattern(FIELD_SYNONYMS[field])


def any_field_pattern() -> str:
    return synonyms_pattern([x for v in FIELD_SYNONYMS.values() for x in v])


def display_value(c: Column, empty: str = "（空值）") -> Column:
    """Control characters as U+FFFD, trimmed, a marker for empty, at most 2000 characters (FLT13)."""
    clean = js_trim(F.regexp_replace(c, "[\\x00-\\x1F\\x7F]", "�"))
    return F.when(clean == "", F.lit(empty)).when(F.length(clean) > 2000, F.concat(F.substring(clean, 1, 1997), F.lit("…"))).otherwise(clean)
