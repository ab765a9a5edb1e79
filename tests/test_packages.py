"""Readers of package parts and their checks on odd input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.operators import metadata, package
from paperloom.sources import packages

W = f'xmlns:w="{packages.WORD_NS}"'
CORE = f'xmlns:cp="{packages.CORE_NS}" xmlns:dc="{packages.DC_NS}"'
CUSTOM = f'xmlns="{packages.CUSTOM_NS}" xmlns:vt="{packages.VALUES_NS}"'

TARGETS = {
    ("word/document.xml", "styles.xml"): "word/styles.xml", ("word/document.xml", "/a/b"): "a/b", ("word/document.xml", "../x.xml"): "x.xml", ("word/document.xml", "../../x.xml"): None,
    ("word/document.xml", "a/../../../x"): None, ("word/document.xml", "."): "word", ("", "word/document.xml"): "word/document.xml", ("", ".."): None, ("", "./a//b/"): "a/b",
    ("word/d.xml", "a.xml?q#f"): "word/a.xml", ("word/d.xml", "#f"): None, ("word/d.xml", ""): None, ("word/d.xml", "a%20b+c.xml"): "word/a b+c.xml", ("word/d.xml", "%2e%2E/x"): None, ("word/d.xml", "a%2fb"): None,
    ("word/d.xml", "a%255cb"): None, ("word/d.xml", "a%zzb"): None, ("word/d.xml", "a%C3%A9"): "word/aé", ("word/d.xml", "a%C3"): None, ("word/d.xml", "a\\b"): None, ("word/d.xml", "http://x/y"): None, ("word/d.xml", "C:x"): None,
    ("word/d.xml", "/"): None, ("word/d.xml", None): None, ("word/d.xml", "x" * 20_000): "word/" + "x" * 20_000,
}


def test_targets(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(TARGETS)], "i int, s string, t string")
    got = {r["i"]: r["p"] for r in df.select("i", package.resolved_target(F.col("s"), F.col("t")).alias("p")).collect()}
    assert {k: got[i] for i, k in enumerate(TARGETS)} == TARGETS


def _parts(spark, rows):
    return spark.createDataFrame([(d, i, n, c if isinstance(c, (bytes, type(None))) else c.encode(), False) for i, (d, n, c) in enumerate(rows)], "doc_id string, ord int, name string, contents binary, is_dir boolean")


def _mask(spark, name, *texts):
    got = packages.scan_metadata_parts(_parts(spark, [(str(i), name, t) for i, t in enumerate(texts)])).collect()
    return [r["masked_sha256"] for r in sorted(got, key=lambda r: int(r["doc_id"]))]


def test_masked_form(spark):
    core = lambda who, more="": f"<cp:coreProperties {CORE}><dc:creator>{who}</dc:creator>{more}</cp:coreProperties>"
    a, *same, other, kept = _mask(spark, "docProps/core.xml", core("Ann"), core("Bob &amp; Co"), core("<![CDATA[x]]>"), core(""), core("Ann", "<!--note-->"), core("Ann", "<creator>Ann</creator>"))
    assert all(x == a for x in same) and len({a, other, kept}) == 3
    # invalid values are no slots; a value out of bounds is a warning
    prop = lambda kind, v: f"<Properties {CUSTOM}><property>\n<vt:{kind}>{v}</vt:{kind}></property></Properties>"
    a, b, c, d, e = _mask(spark, "docProps/custom.xml", prop("ui1", 7), prop("ui1", 255), prop("ui1", 256), prop("ui1", 257), prop("ui2", 7))
    assert a == b and len({a, c, d, e}) == 4
    word = lambda attrs, text="t": f"<w:document {W}><w:p><w:del {attrs}><w:t>{text}</w:t></w:del></w:p></w:document>"
    a, b, c, d, e = _mask(spark, "word/document.xml", word('w:author="A" w:id="1"'), word("w:author='B' w:id='1'"), word('w:author="A" w:id="2"'), word('author="A" w:id="1"'), word('w:author="A" w:id="1"', "u"))
    assert a == b and len({a, c, d, e}) == 4


def test_occurrences_of_odd_parts(spark):
    rows = [
        ("a", "docProps/core.xml", f"<cp:coreProperties {CORE}><cp:revision>x</cp:revision><dc:creator>A<b>B</b></dc:creator><dc:creator/></cp:coreProperties>"),
        ("a", "docProps/custom.xml", f"<Properties {CUSTOM}><property><vt:i1>-129</vt:i1></property><property><vt:bool>TRUE</vt:bool></property><property><vt:r8>1e</vt:r8></property><property><i1>1</i1></property><property/><property><vt:i1>1</vt:i1><vt:i1>2</vt:i1></property></Properties>"),
        ("a", "word/x/y.xml", f'<w:x {W} xmlns:v="{packages.WORD_NS}"><w:p w:author="no"/><v:ins v:author="yes" w:date="2020-13-01"/><v:comment v:initials=""/></w:x>'),
        ("b", "docProps/custom.xml", "<Properties/>"),
        ("b", "word/document.xml", "<w:x>"),
        ("b", "docProps/app.xml", None),
        ("b", "word/media/a.png", b"\x00"),
    ]
    scanned = packages.scan_metadata_parts(_parts(spark, rows))
    assert {(r["part"], r["error_code"]) for r in scanned.filter("doc_id = 'b'").collect()} == {("docProps/custom.xml", "INVALID_DOCUMENT"), ("word/document.xml", "INVALID_DOCUMENT"), ("docProps/app.xml", "INVALID_DOCUMENT")}
    got = [(r["locator"], r["action"], r["value_type"], r["original_value"]) for r in packages.package_occurrences(scanned).orderBy("part", "pos").collect()]
    assert got == [
        (f"element:{packages.DC_NS}:creator:0", "randomize", "string", "AB"),
        (f"element:{packages.DC_NS}:creator:1", "randomize", "string", ""),
        (f"element:{packages.CORE_NS}:revision:0", "warn", "integer", "x"),
        ("custom:0", "warn", "integer", "-129"),
        ("custom:1", "randomize", "boolean", "TRUE"),
        ("custom:2", "warn", "number", "1e"),
        ("custom:3", "warn", "string", "1"),
        ("custom:4", "warn", "string", ""),
        ("custom:5", "warn", "string", ""),
        ("word-element:0:attribute:author", "randomize", "string", "yes"),
        ("word-element:0:attribute:date", "warn", "timestamp", "2020-13-01"),
        ("word-element:1:attribute:initials", "randomize", "initials", ""),
    ]


TYPES = f'<Types xmlns="{packages.TYPES_NS}"><Override PartName="/word/document.xml" ContentType="{package.MAIN_TYPE}"/></Types>'
ROOT = f'<Relationships xmlns="{packages.RELS_NS}"><Relationship Type="x/officeDocument" Target="word/document.xml"/></Relationships>'
GOOD = {"[Content_Types].xml": TYPES, "_rels/.rels": ROOT, "word/document.xml": "<x/>"}


@pytest.mark.parametrize(
    ("changed", "code"),
    [
        ({}, None), ({"word/document.xml": None}, "INVALID_DOCUMENT"), ({"[Content_Types].xml": "<Types/>"}, "INVALID_DOCUMENT"), ({"[Content_Types].xml": TYPES.replace("main+xml", "x")}, "UNSUPPORTED_TYPE"),
        ({"word/VBAProject.BIN": "x"}, "UNSUPPORTED_TYPE"), ({"notvbaProject.bin": "x"}, None), ({"_xmlSignatures/a": "x"}, "SIGNED_DOCUMENT"), ({"_rels/.rels": ROOT.replace("<Relationship ", "<Relationship TargetMode='External' ")}, "INVALID_DOCUMENT"),
        ({"_rels/.rels": "<x"}, "INVALID_DOCUMENT"), ({"a.rels": ROOT}, "INVALID_DOCUMENT"), ({"word/_rels/document.xml.rels": "<x"}, "INVALID_DOCUMENT"), ({"word/_rels/document.xml.rels": f'<Relationships xmlns="{packages.RELS_NS}"/>'}, None),
        ({"word/_rels/document.xml.rels": ROOT.replace("x/officeDocument", "x/Digital-Signature/y").replace("word/document.xml", "document.xml")}, "SIGNED_DOCUMENT"),
        ({"word/_rels/document.xml.rels": ROOT.replace("<Relationships ", "<Relationships a='1' ").replace("word/document.xml", "")}, "INVALID_DOCUMENT"),
    ],
)
def test_inspection(spark, changed, code):
    parts = _parts(spark, [("d", n, c) for n, c in (GOOD | changed).items() if c is not None])
    (got,) = package.inspect_packages(parts, packages.content_types(parts), packages.relationships(parts)).collect()
    assert got["error_code"] == code


def test_masked_diff_of_unreadable_parts(spark):
    core = f"<cp:coreProperties {CORE}><dc:creator>A</dc:creator></cp:coreProperties>"
    s = _parts(spark, [("a", "docProps/core.xml", core), ("b", "word/x.xml", "<"), ("c", "word/x.xml", "<a/>"), ("d", "docProps/core.xml", core)])
    o = _parts(spark, [("a", "docProps/core.xml", "<"), ("b", "word/x.xml", "<"), ("c", "word/x.xml", "<a />"), ("d", "docProps/core.xml", core.replace(">A<", ">B<"))])
    got = metadata.masked_content_diff(s, o, packages.scan_metadata_parts(s), packages.scan_metadata_parts(o)).collect()
    assert {(r["doc_id"], r["reason"]) for r in got} == {("a", "invalid"), ("b", "invalid"), ("c", "changed")}
