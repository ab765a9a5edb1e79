"""What a package says about itself: content types, relationships, identity metadata, masked fingerprints.

Each XML part is read once as a stream of events; a part that is not well formed, or has another root than
its role asks for, is a row with an error code.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime
from xml.parsers.expat import ExpatError, ParserCreate
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import INTEGER_BOUNDS, WS
from .files import APP, CORE, CUSTOM

#: Namespaces of packages.
TYPES_NS = "http://schemas.openxmlformats.org/package/2006/content-types"
RELS_NS = "http://schemas.openxmlformats.org/package/2006/relationships"
CORE_NS = "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"
DC_NS = "http://purl.org/dc/elements/1.1/"
DCTERMS_NS = "http://purl.org/dc/terms/"
APP_NS = "http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"
CUSTOM_NS = "http://schemas.openxmlformats.org/officeDocument/2006/custom-properties"
VALUES_NS = "http://schemas.openxmlformats.org/officeDocument/2006/docPropsVTypes"
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
#: Core properties of the two Dublin Core namespaces; the others have the namespace of the part.
_DC, _DCTERMS = {"creator", "identifier", "title", "subject", "description"}, {"created", "modified"}
#: Elements whose author, initials and date are identity.
IDENTITY_ELEMENTS = {
    "comment", "cellDel", "cellIns", "cellMerge", "customXmlDelRangeStart", "customXmlInsRangeStart", "customXmlMoveFromRangeStart", "customXmlMoveToRangeStart",
    "del", "ins", "moveFrom", "moveFromRangeStart", "moveTo", "moveToRangeStart", "numberingChange", "pPrChange", "rPrChange", "sectPrChange", "tblGridChange", "tblPrChange",
    "tcPrChange", "trPrChange",
}
_IDENTITY = {"author": ("string", "person"), "initials": ("initials", "initials"), "date": ("timestamp", "timestamp")}
_TRIM = re.compile(f"^{WS}+|{WS}+$")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|0[xX][0-9A-Fa-f]+|0[oO][0-7]+|0[bB][01]+", re.ASCII)
_TIME = re.compile(r"(\d{4}-\d\d-\d\d)(?:T(\d\d:\d\d(?::\d\d)?)(?:\.\d+)?(Z|[+-]\d\d:\d\d)?)?", re.ASCII)


def value_valid(value: str, kind: str) -> bool:
    """A legal value of its type; times in ISO form."""
    v = _TRIM.sub("", value)
    if kind == "integer":
        return re.fullmatch("-?[0-9]+", v) is not None
    if kind == "number":
        return _NUMBER.fullmatch(v) is not None
    if kind == "boolean":
        return v.lower() in ("true", "false", "0", "1")
    if kind == "timestamp":
        m = _TIME.fullmatch(v)
        try:
            return m is not None and datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00'}") is not None
        except ValueError:
            return False
    return True


def _specs(part: str) -> dict[tuple[str, str], tuple]:
    """(namespace, element) to (order, field, category, type, action, alias kind) of a property part."""
    if part == "docProps/core.xml":
        space = lambda e: DC_NS if e in _DC else DCTERMS_NS if e in _DCTERMS else CORE_NS
        return {(space(e), e): (i, f"core:{e}", *x) for i, (e, x) in enumerate(CORE.items())}
    return {(APP_NS, e): (i, f"app:{e}", *x) for i, (e, x) in enumerate(APP.items())}


class _Reader:
    """Events of an XML part with namespaces, and its canonical form as a stream of tokens.

    Prefixes, the order of attributes, comments and declarations belong to the form; quotes, entities and empty tags do not.
    """

    def __init__(self) -> None:
        self.parser = p = ParserCreate()
        p.ordered_attributes = p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = self._start, self._end, self.text
        p.CommentHandler = lambda x: self.token(f"<!--{x}-->")
        p.ProcessingInstructionHandler = lambda a, b: self.token(f"<?{a} {b}?>")
        p.XmlDeclHandler = lambda *x: self.token(f"<?xml {x}?>")
        p.StartDoctypeDeclHandler = lambda *x: self.token(f"<!DOCTYPE {x}>")
        p.StartCdataSectionHandler, p.EndCdataSectionHandler = lambda: self.token("<![CDATA["), lambda: self.token("]]>")
        self.scopes: list[dict[str, str]] = [{"": "", "xml": "http://www.w3.org/XML/1998/namespace"}]
        self.hash = hashlib.sha256()

    def read(self, contents: bytes) -> str:
        self.parser.Parse(bytes(contents), True)
        return self.hash.hexdigest()

    def token(self, text: str) -> None:
        self.hash.update(text.encode("utf-8", "surrogatepass"))

    def text(self, text: str) -> None:
        self.token(escape(text))

    def _name(self, name: str, attribute: bool = False) -> tuple[str, str]:
        prefix, _, local = name.rpartition(":")
        return "" if attribute and not prefix else self.scopes[-1].get(prefix, "?" + prefix), local

    def _start(self, name: str, attrs: list[str]) -> None:
        pairs = list(zip(attrs[::2], attrs[1::2], strict=True))
        new = {k[6:]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        self.scopes.append(self.scopes[-1] | new if new else self.scopes[-1])
        if len(self.scopes) == 2:
            self.root(*self._name(name))
        self.start(name, self._name(name), pairs)

    def _end(self, name: str) -> None:
        self.end(name, self._name(name))
        self.scopes.pop()

    def root(self, space: str, local: str) -> None:
        pass

    def start(self, name: str, qualified: tuple[str, str], attrs: list[tuple[str, str]]) -> None:
        self.token(f"<{name}" + "".join(f' {k}="{escape(v, {chr(34): "&quot;"})}"' for k, v in attrs) + ">")

    def end(self, name: str, qualified: tuple[str, str]) -> None:
        self.token(f"</{name}>")


class _Metadata(_Reader):
    """Occurrences of identity metadata of a part; values to randomise are slots of their kind in the canonical form."""

    def __init__(self, part: str):
        super().__init__()
        self.part, self.found = part, []
        self.custom, self.word = part == "docProps/custom.xml", part.startswith("word/")
        self.specs = {} if self.custom or self.word else _specs(part)
        self.counts: dict = {}
        self.held: list[str] | None = None  # tokens of an open property, until its value is known
        self.frame: dict = {}

    def root(self, space, local):
        if self.custom and (space, local) != (CUSTOM_NS, "Properties"):
            raise ValueError("root")

    def token(self, text):
        if self.held is None:
            super().token(text)
        else:
            self.held.append(text)

    def text(self, text):
        if self.held is not None and (not self.custom or self.frame["depth"] > 1):
            self.frame["value"].append(text)
        super().text(text)

    def _add(self, order: tuple, locator: str, field: str, category: str, kind: str, action: str, alias: str | None, value: str) -> bool:
        valid = action != "randomize" or value_valid(value, kind)
        self.found.append((order, locator, field, category, kind, action if valid else "warn", alias if valid and action == "randomize" else None, value))
        return valid and action == "randomize"

    def start(self, name, qualified, attrs):
        if self.word and qualified[0] == WORD_NS and qualified[1] in IDENTITY_ELEMENTS:
            attrs = self._identity(attrs)
        opens = self.held is None and (qualified == (CUSTOM_NS, "property") if self.custom else qualified in self.specs)
        if opens:
            super().start(name, qualified, attrs)
            self.held, self.frame = [], {"depth": 1, "name": qualified, "value": [], "children": []}
            return
        if self.held is not None:
            self.frame["depth"] += 1
            if self.frame["depth"] == 2:
                self.frame["children"].append([qualified, len(self.held) + 1, None])
        super().start(name, qualified, attrs)

    def _identity(self, attrs):
        index = self.counts["word"] = self.counts.get("word", -1) + 1
        values = {self._name(k, True): v for k, v in attrs}
        masked = set()
        for i, (a, (kind, alias)) in enumerate(_IDENTITY.items()):
            if (value := values.get((WORD_NS, a))) is None:
                continue
            category = "timestamp" if a == "date" else "comment-identity" if "comments" in self.part else "revision-identity"
            if self._add((index, i), f"word-element:{index}:attribute:{a}", f"{self.part}:w:{a}", category, kind, "randomize", alias, value):
                masked.add((WORD_NS, a))
        return [(k, f"\0{self._name(k, True)[1]}" if self._name(k, True) in masked else v) for k, v in attrs]

    def end(self, name, qualified):
        if self.held is None:
            return super().end(name, qualified)
        self.frame["depth"] -= 1
        if self.frame["depth"] == 1:
            self.frame["children"][-1][2] = len(self.held)
        if self.frame["depth"]:
            return super().end(name, qualified)
        held, frame = self.held, self.frame
        value, self.held = "".join(frame["value"]), None
        if self.custom:
            held = self._property(held, frame, value)
        else:
            order, field, category, kind, action, alias = self.specs[frame["name"]]
            n = self.counts[order] = self.counts.get(order, -1) + 1
            if self._add((order, n), f"element:{':'.join(frame['name'])}:{n}", field, category, kind, action, alias, value):
                held = [f"\0{alias}"]
        for t in held:
            super().token(t)
        return super().end(name, qualified)

    def _property(self, held, frame, value):
        n = self.counts["custom"] = self.counts.get("custom", -1) + 1
        children = frame["children"]
        (space, local), begin, end = children[0] if len(children) == 1 else (("", ""), 0, 0)
        kind = "integer" if local in INTEGER_BOUNDS else CUSTOM.get(local) if space == VALUES_NS else None
        kind = kind if space == VALUES_NS else None
        good = kind is not None and value_valid(value, kind)
        if good and kind == "integer":
            low, high = INTEGER_BOUNDS[local]
            good = low <= int(_TRIM.sub("", value)) <= high
        alias = "description" if kind == "string" else kind
        value = value if len(children) == 1 else ""
        self._add((n,), f"custom:{n}", f"custom:property:{n + 1}", "custom-property", kind or "string", "randomize" if good else "warn", alias if good else None, value)
        return [*held[:begin], f"\0{alias}", *held[end:]] if good else held


METADATA_PARTS = "^docProps/(core|app|custom)\\.xml\\z|^word/.*\\.xml\\z"
_OCCURRENCE = "struct<locator:string,pos:int,field:string,category:string,value_type:string,action:string,replacement_kind:string,original_value:string>"
_NAMES = ["locator", "pos", "field", "category", "value_type", "action", "replacement_kind", "original_value"]


def scan_metadata_parts(parts: DataFrame) -> DataFrame:
    """`doc_id, part, occurrences, masked_sha256, error_code`: one row for each property or Word part (SRC5).

    `masked_sha256` is the hash of the canonical form with the values to randomise left out. Custom properties of unknown type,
    with a value out of bounds or without exactly one value are kept as warnings, as are invalid values of other fields.
    """

    def scanned(name: str, contents: bytes | None) -> tuple:
        try:
            reader = _Metadata(name)
            sha = reader.read(contents)
        except (ExpatError, ValueError, TypeError):
            return None, None, "INVALID_DOCUMENT"
        rows = [dict(zip(_NAMES, (x[1], i, *x[2:]), strict=True)) for i, x in enumerate(sorted(reader.found, key=lambda x: x[0]))]
        return rows, sha, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, n, *scanned(n, c)) for d, n, c in zip(b["doc_id"], b["name"], b["contents"], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "part", "occurrences", "masked_sha256", "error_code"], dtype=object)

    wanted = parts.filter(F.col("name").rlike(METADATA_PARTS)).select("doc_id", "name", "contents")
    return wanted.mapInPandas(run, f"doc_id string, part string, occurrences array<{_OCCURRENCE}>, masked_sha256 string, error_code string")


def package_occurrences(scanned: DataFrame) -> DataFrame:
    """One row per occurrence of `scan_metadata_parts`."""
    return scanned.select("doc_id", "part", F.explode("occurrences").alias("x")).select("doc_id", "part", "x.*")


class _List(_Reader):
    """Attributes of the elements of one namespace in a part whose root is given."""

    def __init__(self, space: str, root: str, names: set[str]):
        super().__init__()
        self.wanted, self.space, self.names, self.rows = root, space, names, []

    def root(self, space, local):
        if (space, local) != (self.space, self.wanted):
            raise ValueError("root")

    def token(self, text):
        pass

    def start(self, name, qualified, attrs):
        if qualified[0] == self.space and qualified[1] in self.names:
            self.rows.append((qualified[1], dict(attrs)))


def _listed(space: str, root: str, names: set[str], contents: bytes) -> tuple[list, str | None]:
    try:
        reader = _List(space, root, names)
        reader.read(contents)
        return reader.rows, None
    except (ExpatError, ValueError, TypeError):
        return [], "INVALID_DOCUMENT"


def content_types(parts: DataFrame) -> DataFrame:
    """`doc_id, kind, key, content_type, error_code` of the content-type parts: defaults by extension, overrides by part name (FLT15)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc, contents in zip(b["doc_id"], b["contents"], strict=True):
                found, error = _listed(TYPES_NS, "Types", {"Default", "Override"}, contents)
                rows += [(doc, k.lower(), a.get("PartName" if k == "Override" else "Extension"), a.get("ContentType"), None) for k, a in found]
                if error:
                    rows.append((doc, None, None, None, error))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "key", "content_type", "error_code"], dtype=object)

    wanted = parts.filter("name = '[Content_Types].xml'").select("doc_id", "contents")
    return wanted.mapInPandas(run, "doc_id string, kind string, key string, content_type string, error_code string")


def relationships(parts: DataFrame) -> DataFrame:
    """`doc_id, rels_part, source_part, rel_id, type, target, external, error_code`: one row per relationship (JN11).

    `source_part` is "" for the package and null for a part in a place where no relationships may be; a part that cannot be read, or has none,
    has one row without a target: with an error, or with `rel_id` null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc, name, contents in zip(b["doc_id"], b["name"], b["contents"], strict=True):
                found, error = _listed(RELS_NS, "Relationships", {"Relationship"}, contents)
                rows += [(doc, name, a.get("Id"), a.get("Type"), a.get("Target"), a.get("TargetMode") == "External", True, None) for _, a in found]
                if not found:
                    rows.append((doc, name, None, None, None, False, False, error))
            yield pd.DataFrame(rows, columns=["doc_id", "rels_part", "rel_id", "type", "target", "external", "is_row", "error_code"], dtype=object)

    wanted = parts.filter(F.col("name").endswith(".rels")).select("doc_id", "name", "contents")
    out = wanted.mapInPandas(run, "doc_id string, rels_part string, rel_id string, type string, target string, external boolean, is_row boolean, error_code string")
    place = F.regexp_extract("rels_part", "^(.*/)?_rels/([^/]+)\\.rels\\z", 1), F.regexp_extract("rels_part", "^(.*/)?_rels/([^/]+)\\.rels\\z", 2)
    source = F.when(F.col("rels_part") == "_rels/.rels", "").when(place[1] != "", F.concat(*place))
    return out.withColumn("source_part", source).select("doc_id", "rels_part", "source_part", "rel_id", "type", "target", "external", "is_row", "error_code")
