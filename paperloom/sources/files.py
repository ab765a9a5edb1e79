"""Files as tables: snapshots, package parts, document nodes, metadata occurrences, diagnostics.

One bad file is a row with an error code, never a failed job.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DIAGNOSTICS, PARTS

MAX_FILE = 200 << 20
MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY = 10_000, 1 << 30, 256 << 20
#: Bytes of unpacked entries held at once, beside the largest one.
BATCH = 16 << 20
#: Entries handed on at once.
BATCH_ROWS = 2_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TRIM = re.compile("^[\\s﻿]+|[\\s﻿]+$")


def file_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: name, type, size, sha256, time; error_code by extension, magic bytes or size (SRC1).

    The size is tested on the listing, before any content is read. Spark's reader gives no rows for empty files, and
    content passes as one cell: `archives.digest_files` does neither.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = lambda d: d.withColumn("head", F.substring("content", 1, 5)).withColumn("sha256", F.sha2("content", 256)).drop("content")
    small = read(f.filter(F.col("length") <= MAX_FILE))
    large = f.filter(F.col("length") > MAX_FILE).drop("content").withColumn("head", F.lit(None).cast("binary")).withColumn("sha256", F.lit(None).cast("string"))
    return judged_files(small.unionByName(large).withColumn("mtime_ms", F.unix_millis("modificationTime").cast("double")), MAX_FILE)


def judged_files(d: DataFrame, max_file: int) -> DataFrame:
    """Snapshot rows of `d(path, length, mtime_ms, head, sha256)`, `head` being the first five bytes."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)\\z", 1))
    kind = F.when(ext.isin("docx", "pdf"), ext)
    magic = F.when(kind == "pdf", F.hex("head") == "255044462D").when(kind == "docx", F.hex("head").startswith("504B"))
    code = F.when(F.col("length") > max_file, "FILE_TOO_LARGE").when(kind.isNull(), "UNSUPPORTED_TYPE").when(~F.coalesce(magic, F.lit(False)), "INVALID_DOCUMENT")
    return d.select("path", name.alias("display_name"), kind.alias("document_type"), F.col("length").alias("size"), "sha256", "mtime_ms", code.alias("error_code"))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path) and content of DOCX files within the size limit."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return f.filter(F.col("length") <= MAX_FILE).select(F.col("path").alias("doc_id"), "content")


def docx_parts(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts in archive order, rejects with a code) of `packages(doc_id, content)` (SRC2).

    Entries over the limits come without contents; a broken archive is one reject. Sizes are checked on
    the archive's directory first, then entries go out in batches of `BATCH` bytes, so one archive is never unpacked whole.
    """
    names = ["doc_id", "ord", "name", "contents", "is_dir", "method", "flags", "mode", "size", "compressed_size", "error_code"]

    def readable(e: zipfile.ZipInfo) -> bool:
        return e.file_size <= MAX_ENTRY and not e.flag_bits & 1

    def entries(doc: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            if len(infos) > MAX_ENTRIES or sum(e.file_size for e in infos) > MAX_TOTAL:
                raise ValueError("limits")
            for e in infos:  # checksums first: a broken archive gives no parts
                if readable(e):
                    with z.open(e) as f:
                        while f.read(1 << 20):
                            pass
            for i, e in enumerate(infos):
                yield doc, i, e.filename, z.read(e) if readable(e) else None, e.is_dir(), e.compress_type, e.flag_bits, e.external_attr >> 16, e.file_size, e.compress_size, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0  # of many small packages or a piece of a large one
        for b in batches:
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                own = len(rows)
                try:
                    for row in entries(doc, bytes(content)):
                        rows.append(row)
                        size += len(row[3] or b"")
                        if size > BATCH:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows, size, own = [], 0, 0
                except Exception:  # noqa: BLE001  whatever is wrong with a file, it is that file's row
                    rows[own:] = [(doc, None, None, None, None, None, None, None, None, None, "INVALID_DOCUMENT")]
                if len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)

    out = packages.select("doc_id", "content").mapInPandas(run, f"{PARTS}, error_code string")
    return out.filter("error_code is null").drop("error_code"), out.filter("error_code is not null").select("doc_id", "error_code")


def _text(e: ET.Element) -> str:
    return _TRIM.sub("", "".join(t.text or "" for t in e.iter(W + "t")))


def _paragraph(p: ET.Element, n: int) -> tuple:
    style = next((s.get(W + "val") for s in p.iter(W + "pStyle")), None)
    outline = next((o.get(W + "val") for o in p.iter(W + "outlineLvl")), None)
    return f"p-{n}", "paragraph", _text(p), style, int(outline) if outline and outline.isdigit() else None


def _body(root: ET.Element) -> Iterator[tuple]:
    """Paragraphs, content-control children and table cells in order."""
    paragraphs = tables = 0
    body = root.find(W + "body")
    blocks: list[ET.Element] = []
    for child in body if body is not None else []:
        if child.tag == W + "sdt":
            content = next(child.iter(W + "sdtContent"), None)
            blocks.extend(content if content is not None else [])
        else:
            blocks.append(child)
    for block in blocks:
        if block.tag == W + "p":
            yield _paragraph(block, paragraphs)
            paragraphs += 1
        elif block.tag == W + "tbl":
            for r, row in enumerate(block.iter(W + "tr")):
                for c, cell in enumerate(row.iter(W + "tc")):
                    yield f"cell-{tables}-{r}-{c}", "cell", _text(cell), None, None
            tables += 1


def docx_nodes(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, styles): body nodes, then headers and footers, each with its style id and own outline; and
    the style table that `outline_levels` joins (SRC3). A document's XML parts pass one by one, the body first."""
    xml = parts.filter(F.col("name").rlike("^word/(document\\.xml|styles\\.xml|header[^/]*|footer[^/]*)\\z"))
    cols = ["doc_id", "pos", "node_id", "kind", "text", "style_id", "outline"]

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, count = None, 0
        for b in batches:
            rows: list[tuple] = []
            for d, name, contents in zip(b["doc_id"], b["name"], b["contents"], strict=True):
                if d != doc:
                    doc, count = d, 0
                try:
                    root = ET.fromstring(bytes(contents))
                except (ET.ParseError, TypeError):
                    continue
                found: list[tuple] = []
                if name == "word/document.xml":
                    found = list(_body(root))
                elif text := _text(root):
                    kind = "header" if name.startswith("word/header") else "footer"
                    found = [(f"{kind}-{count}", kind, text, None, None)]
                rows += [(d, count + i, *r) for i, r in enumerate(found)]
                count += len(found)
            yield pd.DataFrame(rows, columns=cols, dtype=object)

    def styles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, contents in zip(b["doc_id"], b["contents"], strict=True):
                try:
                    root = ET.fromstring(bytes(contents))
                except (ET.ParseError, TypeError):
                    continue
                for s in root.iter(W + "style"):
                    if s.get(W + "styleId"):
                        name = next((n.get(W + "val") for n in s.iter(W + "name")), None)
                        outline = next((o.get(W + "val") for o in s.iter(W + "outlineLvl")), None)
                        rows.append((doc, s.get(W + "styleId"), name, int(outline) if outline and outline.isdigit() else None))
            yield pd.DataFrame(rows, columns=["doc_id", "style_id", "name", "outline"], dtype=object)

    body = xml.filter("name <> 'word/styles.xml'").withColumn("_later", F.col("name") != "word/document.xml")
    body = body.repartition("doc_id").sortWithinPartitions("doc_id", "_later", "ord").select("doc_id", "name", "contents")
    n = body.mapInPandas(nodes, "doc_id string, pos long, node_id string, kind string, text string, style_id string, outline int")
    s = xml.filter("name = 'word/styles.xml'").select("doc_id", "contents").mapInPandas(styles, "doc_id string, style_id string, name string, outline int")
    return n, s


def with_headings(nodes: DataFrame, styles: DataFrame) -> DataFrame:
    """Nodes with kind and level after style lookup and the heading heuristics."""
    from ..operators.nodes import heading_heuristics, outline_levels

    d = outline_levels(nodes, styles).drop("style_id", "outline")
    body = F.col("kind") == "paragraph"
    d = d.withColumn("level", F.when(body, F.col("level"))).withColumn("kind", F.when(body & F.col("level").isNotNull(), "heading").otherwise(F.col("kind")))
    return heading_heuristics(d)


#: Property elements of the core and application parts: field, category, type, action, alias kind.
CORE = {
    "creator": ("person-identity", "string", "randomize", "person"), "lastModifiedBy": ("person-identity", "string", "randomize", "person"),
    "created": ("timestamp", "timestamp", "preserve", None), "modified": ("timestamp", "timestamp", "preserve", None), "lastPrinted": ("timestamp", "timestamp", "preserve", None),
    "revision": ("document-identifier", "integer", "randomize", "integer"), "identifier": ("document-identifier", "uuid", "randomize", "uuid"),
    "title": ("description", "string", "randomize", "description"), "subject": ("description", "string", "randomize", "description"), "keywords": ("description", "string", "randomize", "description"),
    "category": ("description", "string", "randomize", "description"), "description": ("description", "string", "randomize", "description"), "contentStatus": ("description", "string", "randomize", "description"),
}
APP = {
    "Company": ("organization", "organization", "randomize", "organization"), "Manager": ("person-identity", "string", "randomize", "person"),
    "Application": ("application", "string", "randomize", "application"), "AppVersion": ("application", "string", "randomize", "application"),
    "Template": ("application", "string", "randomize", "description"), "HyperlinkBase": ("application", "string", "randomize", "description"), "TotalTime": ("application", "integer", "randomize", "integer"),
    "Pages": ("application", "integer", "preserve", None), "Words": ("application", "integer", "preserve", None), "Characters": ("application", "integer", "preserve", None),
    "CharactersWithSpaces": ("application", "integer", "preserve", None), "Lines": ("application", "integer", "preserve", None), "Paragraphs": ("application", "integer", "preserve", None),
}
#: Value types of custom properties.
CUSTOM = {"lpwstr": "string", "lpstr": "string", "bstr": "string", "r4": "number", "r8": "number", "decimal": "number", "cy": "number", "bool": "boolean", "filetime": "timestamp", "date": "timestamp"}
#: Attributes of comments and revisions that carry identity.
IDENTITY = {"author": ("person-identity", "string", "person"), "initials": ("person-identity", "string", "initials"), "date": ("timestamp", "timestamp", "timestamp")}


def docx_metadata(parts: DataFrame) -> DataFrame:
    """Occurrences of identity metadata in property parts and comment and revision attributes (SRC5)."""
    wanted = parts.filter(F.col("name").rlike("^docProps/(core|app|custom)\\.xml\\z|^word/(document|comments|header[^/]*|footer[^/]*)\\.xml\\z"))
    names = ["doc_id", "part", "locator", "pos", "field", "category", "value_type", "action", "replacement_kind", "original_value"]

    def found(name: str, root: ET.Element) -> Iterator[tuple]:
        local = lambda e: e.tag.rpartition("}")[2]
        if name in ("docProps/core.xml", "docProps/app.xml"):
            specs, prefix = (CORE, "core") if "core" in name else (APP, "app")
            count: dict[str, int] = {}
            for e in root.iter():
                if local(e) in specs:
                    k = count[local(e)] = count.get(local(e), -1) + 1
                    category, type_, action, kind = specs[local(e)]
                    yield f"{local(e)}[{k}]", f"{prefix}:{local(e)}", category, type_, action, kind, e.text or ""
        elif name == "docProps/custom.xml":
            for i, e in enumerate(x for x in root.iter() if local(x) == "property"):
                value = next(iter(e), None)
                if value is None:
                    continue
                t = local(value)
                integer = t in ("i1", "i2", "i4", "int", "i8", "ui1", "ui2", "ui4", "uint", "ui8")
                type_ = "integer" if integer else CUSTOM.get(t)
                kind = "description" if type_ == "string" else type_
                yield f"property[{i}]", "custom:property", "custom", type_ or "string", "randomize" if type_ else "warn", kind, value.text or ""
        else:
            for i, e in enumerate(root.iter()):
                for a, (category, type_, kind) in IDENTITY.items():
                    if e.get(W + a) is not None:
                        yield f"{local(e)}[{i}]@{a}", f"word:{a}", category, type_, "randomize", kind, e.get(W + a)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, name, contents in zip(b["doc_id"], b["name"], b["contents"], strict=True):
                try:
                    root = ET.fromstring(bytes(contents))
                except (ET.ParseError, TypeError):
                    continue
                rows += [(doc, name, x[0], i, *x[1:]) for i, x in enumerate(found(name, root))]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    schema = "doc_id string, part string, locator string, pos int, field string, category string, value_type string, action string, replacement_kind string, original_value string"
    return wanted.select("doc_id", "name", "contents").mapInPandas(run, schema)


#: Values a diagnostic event may have.
STAGES = ["read", "inspect", "plan", "sanitize", "verify", "publish", "review", "generate", "ai", "update", "settings"]


def read_diagnostics(spark: SparkSession, path: str, stages: list[str] | None = None) -> DataFrame:
    """JSON lines of diagnostic events; malformed and off-schema lines are dropped (SRC7)."""
    d = spark.read.schema(f"{DIAGNOSTICS}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return d.filter(F.col("_corrupt").isNull() & F.col("timestamp").isNotNull() & F.col("detailId").isNotNull() & F.col("stage").isin(*(stages or STAGES))).drop("_corrupt")


