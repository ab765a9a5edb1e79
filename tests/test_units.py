"""Cases worked out by hand for operators that SQL cannot state."""

from __future__ import annotations

import hashlib
import hmac
import io
import random
import re
import zipfile
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import keyed
from paperloom.functions.staging import stage
from paperloom.functions.text import JS_WHITE, js_trim, label_pattern, normalize_text, normalize_value
from paperloom.plans.queries import queries
from paperloom.operators import chunks, facts, fillplan, grounding, metadata, nodes, package, quality, review, templates
from paperloom.functions.vocab import WS
from paperloom.sources import files
from paperloom.streaming import logs


def _nodes(spark, texts, doc="d", kinds=None):
    rows = [(doc, i, f"n{i}", (kinds or ["paragraph"] * len(texts))[i], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, pos long, node_id string, kind string, text string")


def _facts(spark, *texts):
    return [(r["kind"], r["ord"], r["node_id"], r["value"]) for r in facts.extract_facts(_nodes(spark, texts)).orderBy("kind", "ord").collect()]


def test_normalize(spark):
    cases = {"（ＡＢＣ）　x": "(abc)x", "A﻿ b": "ab", "①": "1", "plain Text": "plaintext", "": ""}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r["t"]: r["n"] for r in normalize_text(df, "t", "n").collect()}
    assert got == {**cases, None: None}
    assert all(normalize_value(k) == v for k, v in cases.items())


def test_js_trim(spark):
    df = spark.createDataFrame([("﻿　 a b  \n",)], "t string")
    assert df.select(js_trim(F.col("t"))).first()[0] == "a b"


def test_fact_in_next_node(spark):
    assert _facts(spark, "工期：", "", "30天") == [("duration", 0, "n2", "30天")]


def test_fact_repeated_value_and_separator(spark):
    got = _facts(spark, "30天", "工期：30天，质量标准：合格")
    assert got == [("duration", 0, "n1", "30天"), ("quality", 0, "n1", "合格")]


def test_fact_equal_to_its_label(spark):
    assert _facts(spark, "工期：工期") == [("duration", 0, "n0", "工期")]


def test_bidder_name_label(spark):
    assert _facts(spark, "投标人 名称 为 甲公司") == [("bidder_name", 0, "n0", "甲公司")]


def test_label_pattern():
    assert re.fullmatch(label_pattern("注册资本"), "注 册　资本")
    assert re.fullmatch(label_pattern("A.(b)"), "A. ( b )")
    assert not re.fullmatch(label_pattern("A.b"), "Axb")


def test_replace_field(spark):
    def f(text, label, value):
        d = spark.createDataFrame([(text, label, value)], "t string, l string, v string").withColumn("p", fillplan.slot_pattern(F.col("l")))
        return d.select(fillplan.replace_field(F.col("t"), F.col("p"), F.col("v"))).first()[0]

    assert f("地址：____ a", "address", "$1 \\\\ x") == "地址：$1 \\\\ x a"
    assert f("任何", "", "X") == "X"
    assert f("地址：甲邮箱：乙 电话：1", "address", "X") == "地址：X 电话：1"
    assert f("地址：甲邮箱：乙", "address", "X") == "地址：X邮箱：乙"
    assert f("地址：____ 联系电话：____", "address", "X") == "地址：X 联系电话：____"
    assert f("地址：旧址；邮箱：a", "address", "X") == "地址：X；邮箱：a"
    assert f("地址：旧 联系电话：1", "address", "X") == "地址：X 联系电话：1"
    assert f("没有", "address", "X") == "X"
    assert f("规 格：请填写", "规格", "5") == "规 格：5"


def test_apply_actions_in_order(spark):
    n = _nodes(spark, ["地址：____ [[图片]]", "x", None])
    a = spark.createDataFrame([("d", "n0", 1, "placeholder", "图片", None, "certificate"), ("d", "n0", 0, "replace", "address", "Y", None), ("d", "n2", 0, "replace", "address", "Z", None)], "doc_id string, target_node_id string, ord int, action string, label string, value string, placeholder_type string")
    got = {r["node_id"]: r["new_text"] for r in fillplan.apply_actions(n, a).collect()}
    assert got == {"n0": "地址：Y 【请插入：证照】", "n1": "x", "n2": "Z"}


def test_aliases(spark):
    rows = [("d1", "randomize", k, v) for k in ("person", "initials", "organization", "uuid", "integer", "boolean", "timestamp", "description") for v in ("a", "b", "7", "true", "")]
    rows += [("d2", "randomize", "person", "a")] + [("d3", "randomize", "initials", f"p{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id string, action string, replacement_kind string, original_value string")
    got = metadata.aliases(df, b"salt", 1_700_000_000).collect()
    assert len(got) == len(rows)
    shape = {"person": "User-[0-9A-F]{12}", "initials": "[A-Z]{4}", "organization": "Org-[0-9A-F]{12}", "uuid": metadata.UUID4[1:-2], "integer": "\\d+", "boolean": "true|false", "timestamp": "20\\d\\d-.*Z", "description": "Document-[0-9A-F]{16}"}
    seen = set()
    for r in got:
        assert re.fullmatch(shape[r["kind"]], r["alias"]), r
        assert r["alias"] != r["original_value"]
        if r["kind"] in metadata.DISTINCT_KINDS:
            assert (r["doc_id"], r["kind"], r["alias"]) not in seen
            seen.add((r["doc_id"], r["kind"], r["alias"]))
    person = {r["doc_id"]: r["alias"] for r in got if r["kind"] == "person" and r["original_value"] == "a"}
    assert person["d1"] != person["d2"]
    again = {(r["doc_id"], r["kind"], r["original_value"]): r["alias"] for r in metadata.aliases(df.repartition(7), b"salt", 1_700_000_000).collect()}
    assert all(again[r["doc_id"], r["kind"], r["original_value"]] == r["alias"] for r in got)
    assert any(r["attempt"] > 0 for r in got)  # 3000 four-letter initials collide
    one = spark.range(1).select(metadata._hmac(b"key", F.lit("message"))).first()[0]
    assert one == hmac.new(b"key", b"message", hashlib.sha256).hexdigest()


def _packing_laws(texts, ids, rows, most):
    """What makes a packing right, whoever made it: `rows` are (chunk, node, text) in order."""
    cost = lambda r: len(r[2]) + len(r[1]) + 2
    assert [c for c, _, _ in rows] == sorted(c for c, _, _ in rows) and {c for c, _, _ in rows} == set(range(len({c for c, _, _ in rows})))
    at = 0
    for node, text in ((i, t) for i, t in zip(ids, texts, strict=True) if t):  # order kept, nothing lost or repeated
        left = text
        while left:
            assert rows[at][1] == node and rows[at][2] and left.startswith(rows[at][2])
            left, at = left[len(rows[at][2]) :], at + 1
    assert at == len(rows)
    used: dict = {}
    for r in rows:
        used[r[0]] = used.get(r[0], 0) + cost(r)
    assert all(n <= most for n in used.values())
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if a[0] != b[0]:  # a chunk ends only where not one more character had room, or inside a node
            assert used[a[0]] + len(b[1]) + 2 + 1 > most or a[1] == b[1]
        if a[0] != b[0] and a[1] == b[1]:
            assert used[a[0]] == most


@pytest.mark.parametrize("sizes", [[0, 5, 990, 3, 1], [2400] * 4, [996, 996, 997], [995, 1, 1], [3000, 10, 0, 2000], [1] * 400])
def test_chunks(spark, sizes):
    texts = ["".join(chr(97 + (i + k) % 26) for k in range(n)) for i, n in enumerate(sizes)]
    got = [(r["chunk_index"], r["node_id"], r["text"]) for r in chunks.chunk_nodes(_nodes(spark, texts), 1000).orderBy("chunk_index", "piece_ord").collect()]
    _packing_laws(texts, [f"n{i}" for i in range(len(sizes))], got, 1000)


def test_chunks_of_all_documents(spark, sf):
    lines: dict = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        lines[str(r["doc_id"])] = (r["text"] or "").split("\n")
    got: dict = {}
    for r in sorted(queries()["t15_chunk_nodes"](spark, sf).collect(), key=lambda r: (r["chunk_index"], r["piece_ord"])):
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["node_id"], r["text"]))
    for d, texts in lines.items():
        _packing_laws(texts, [f"p-{i}" for i in range(len(texts))], got.get(d, []), 8000)


def test_pseudonyms_of_all_occurrences(spark, sf):
    src = spark.read.parquet(f"{sf}/customer.parquet").collect()
    want = set()
    for r in src:
        d = f"D{r['c_nationkey']}"
        want |= {(d, "person", f"{r['c_name'][:16]}{r['c_custkey'] % 40}"), (d, "organization", r["c_mktsegment"])}
        if r["c_custkey"] % 29:
            want.add((d, "integer", str(r["c_custkey"] % 13)))
    got = queries()["t10_pseudonyms"](spark, sf).collect()
    assert {(r["doc_id"], r["kind"], r["original_value"]) for r in got} == want and len(got) == len(want)
    for r in got:
        message = "\0".join([r["kind"], "string", r["original_value"], r["doc_id"], str(r["attempt"])])
        h = hmac.new(b"fixed for tests", message.encode(), hashlib.sha256).hexdigest()
        n = 1 + int(h[:8], 16) % 2147483646
        same = str(n) == r["original_value"]
        assert r["alias"] == {"person": f"User-{h[:12].upper()}", "organization": f"Org-{h[:12].upper()}", "integer": str(n + same)}[r["kind"]]


def test_alias_plan_apply_verify(spark):
    rows = [("d", "p", f"l{i}", "core:creator", "randomize", "person", f"n{i % 3}", "string") for i in range(9)] + [("d", "p", "x", "app:Pages", "preserve", None, "4", "integer")]
    occ = spark.createDataFrame(rows, "doc_id string, part string, locator string, field string, action string, replacement_kind string, original_value string, value_type string")
    plan = metadata.plan_replacements(occ, metadata.aliases(occ, b"s", 1_700_000_000))
    out = metadata.apply_replacements(occ, plan)
    assert out.filter("error_code is not null").count() == 0
    done = out.withColumn("original_value", F.col("new_value"))
    assert metadata.occurrence_diff(occ, done, plan, F.lit("2030-01-01").cast("timestamp")).count() == 0
    assert metadata.identity_bijection(occ, done).filter("split_originals + shared_aliases > 0").count() == 0
    shown = {r["locator"]: (r["original"], r["replacement"]) for r in metadata.preview_items(occ, plan).collect()}
    assert shown["x"] == ("4", None) and shown["l0"] == shown["l3"] and shown["l0"][0] == "n0"
    broken = done.withColumn("original_value", F.when(F.col("locator") == "l1", "n1").otherwise(F.col("original_value")))
    assert [r["locator"] for r in metadata.occurrence_diff(occ, broken, plan, F.lit("2030-01-01").cast("timestamp")).collect()] == ["l1"]


def test_leftover_blanks(spark):
    n = _nodes(spark, ["地址：____", "x", "[[图片]]"]).withColumn("new_text", F.expr("CASE node_id WHEN 'n0' THEN '地址：A' ELSE text END"))
    assert [r["node_id"] for r in fillplan.leftover_blanks(n).collect()] == ["n2"]


def test_section_ends_by_all_pairs(spark):
    rng = random.Random(3)
    rows = [("d%d" % (i % 3), i, "heading" if rng.random() < 0.8 else "paragraph", rng.choice([None, *range(1, 10)])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id string, pos long, kind string, level int")
    h = [r for r in rows if r[2] == "heading" and r[3] is not None]
    want = {(d, p): min((q for e, q, _, m in h if e == d and q > p and m <= n), default=None) for d, p, _, n in h}
    assert {(r["doc_id"], r["pos"]): r["next_pos"] for r in templates.section_ends(df).collect()} == want


def test_facts_over_many_buckets(spark):
    texts = ["x" * 5000, "工期：", "", "9天", "y" * 9000 + "工期为：", "z", "招标人：" + "甲" * 6000, "\U0001F600项目编号：A-1"]
    got = _facts(spark, *texts)
    assert got == [("duration", 0, "n3", "9天"), ("duration", 1, "n4", "："), ("project_number", 0, "n7", "A-1"), ("role", 0, "n6", "甲" * 6000)]


def test_facts_of_joined_texts_by_python(spark):
    """Nodes one by one and joined texts give what a search of every joined text gives."""
    rng = random.Random(8)
    bits = ["工期", "：", "为", "30天", " ", "，", "投标人", "名称", "项目编号", "A-1/b", "\n", "质量标准:", "合格", "x", "标段", "标段名称：", ""]
    rows, want = [], set()
    for d in range(150):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 6))]
        rows += [(f"d{d}", i, f"n{i}", "paragraph", t) for i, t in enumerate(texts)]
        whole, starts = "\n".join(texts), [sum(len(x) + 1 for x in texts[:i]) for i in range(len(texts))]
        for kind in facts.FACT_LABELS:
            n = 0
            for m in re.finditer(facts.fact_pattern(kind).replace("(?iu)", "(?i)"), whole):
                value = re.sub(f"^{WS}+|{WS}+$", "", m[1])
                begin = m.start() + m[0].find(m[1]) + (len(m[1]) - len(re.sub(f"^{WS}+", "", m[1])))
                k = max((i for i, s in enumerate(starts) if s <= begin), default=0)
                if value and texts[k][begin - starts[k] :].startswith(value):
                    want.add((f"d{d}", kind, n, f"n{k}", value))
                    n += 1
    df = spark.createDataFrame(rows, "doc_id string, pos long, node_id string, kind string, text string")
    assert {(r["doc_id"], r["kind"], r["ord"], r["node_id"], r["value"]) for r in facts.extract_facts(df).collect()} == want and len(want) > 50


def test_chunk_limits(spark):
    with pytest.raises(ValueError, match="max_chars"):
        chunks.chunk_nodes(_nodes(spark, ["a"]), 999)


def test_parse_ai(spark):
    good = '{"findings":[{"type":"other","severity":"warning","confidence":0.5,"summary":"s","suggestion":"x","tenderEvidence":[],"bidEvidence":[]}]}'
    bad = good.replace('"warning"', '"fatal"')
    df = spark.createDataFrame([(1, 0, good), (2, 0, bad), (3, 0, "not json"), (4, 0, "{}"), (5, 0, None)], "pair_id int, chunk_index int, content string")
    assert [r["pair_id"] for r in grounding.parse_ai_review(df).collect()] == [1]
    many = ",".join(f'{{"key":"k{i}","label":"l"}}' for i in range(31))
    df = spark.createDataFrame([("a", f'{{"qualificationSummary":["x", 5, " "],"suggestedFields":[{many}]}}'), ("b", '{"suggestedFields":[{"key":"1x","label":"l"},{"key":"a","label":7},{"key":"a","label":"q"},{"key":"a","label":"r"}]}')], "doc_id string, content string")
    lines, fields = grounding.parse_ai_fields(df)
    assert [(r["doc_id"], r["line"]) for r in lines.collect()] == [("a", "x")]
    assert sum(r["doc_id"] == "a" for r in fields.collect()) == 30
    assert [(r["key"], r["label"]) for r in fields.filter("doc_id = 'b'").collect()] == [("a", "q")]


def test_ground_ai(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    pieces = [("d", 0, 0, "n0", "资格要求 承诺"), ("d", 1, 0, "n1", "b c"), ("d", 1, 1, "n2", None), (None, 0, 0, "n3", "b c")]
    c = spark.createDataFrame(pieces, "doc_id string, chunk_index int, piece_ord int, node_id string, text string")
    rows = [
        ("right", "d", 0, "n0", sha("资格要求 承诺"), "\u3000\ufeff 承诺\n\x0b"),
        ("both", "d", 0, "n0", sha("资格要求 承诺"), "资格要求"),
        ("both", "d", 1, "n1", sha("b c"), "b"),
        ("one wrong", "d", 0, "n0", sha("资格要求 承诺"), "资格要求"),
        ("one wrong", "d", 1, "n1", sha("b c"), "x"),
        ("other chunk", "d", 0, "n1", sha("b c"), "b"),
        ("other document", "e", 1, "n1", sha("b c"), "b"),
        ("no such node", "d", 1, "n9", sha("b c"), "b"),
        ("digest", "d", 1, "n1", sha("b"), "b"),
        ("no digest", "d", 1, "n1", None, "b"),
        ("blank", "d", 1, "n1", sha("b c"), "\u2003 "),
        ("no excerpt", "d", 1, "n1", sha("b c"), None),
        ("no text", "d", 1, "n2", None, "b"),
        ("no document", None, 0, "n3", sha("b c"), "b"),
        ("no chunk", "d", None, "n1", sha("b c"), "b"),
        (None, "d", 1, "n1", sha("b c"), "b"),
    ]
    e = spark.createDataFrame(rows, "finding_id string, doc_id string, chunk_index int, node_id string, digest string, excerpt string")
    asked = spark.createDataFrame([("both",), ("blank",), ("without evidence",)], "finding_id string")
    got = lambda *a: sorted(r["finding_id"] for r in grounding.ground_ai(*a).collect())
    assert got(None, e, None, c) == got(None, e, c, c) == ["both", "right"]
    assert got(asked, e, None, c) == got(asked, e, c, c) == ["both"]
    # a node cut in two: sent is less than stored in one chunk, and both pieces with a line break in the other
    n = spark.createDataFrame([("d", "n0", "one two")], "doc_id string, node_id string, text string")
    c = spark.createDataFrame([("d", 0, 0, "n0", "one "), ("d", 1, 0, "n0", "t"), ("d", 1, 1, "n0", "wo")], c.schema)
    e = spark.createDataFrame([(x, "d", k, "n0", sha("one two"), x) for k, x in [(0, "one"), (0, "one two"), (1, "t"), (1, "two"), (1, "wo")]], e.schema)
    assert got(None, e, n, c) == ["one", "t", "wo"]


def test_js_white(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{c}a{c}b{c}{c}",) for c in chars] + [("",), (" \u3000",), (None,)], "t string")
    assert df.filter(~F.btrim("t", F.lit(JS_WHITE)).eqNullSafe(js_trim(F.col("t")))).count() == 0


def test_ground_ai_shuffles(spark, sf):
    """Lines, evidence, nodes and findings are shuffled once each, and lines are read once."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ["-1", "false"], strict=True):
            spark.conf.set(n, v)
        plan = queries()["jn3_ground_ai"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    assert len(re.findall("- Exchange hashpartitioning", plan)) == 4 and plan.count("ReusedExchange") == 1
    assert plan.count("lineitem.parquet") == 1 and "collect_list" not in plan


def test_fixed_targets(spark):
    n = _nodes(spark, ["工期：30天", "工期：____", "工期：60天", "工期：待填写", "工期：____"])
    c = spark.createDataFrame([("d", "c", 0, 9)], "doc_id string, candidate_id string, start_pos long, end_pos long")
    got = [(r["target_node_id"], r["value"]) for r in fillplan.fixed_targets(c, n, facts.extract_facts(n).filter("value in ('30天', '60天')")).orderBy("target_node_id").collect()]
    assert got == [("n1", "30天"), ("n3", "60天")]


def test_form_and_extra_targets(spark):
    rows = [("d", 0, "cell-0-0-0", "cell", "地 址"), ("d", 1, "cell-0-0-1", "cell", "____"), ("d", 2, "p-1", "paragraph", "联系电话：请填写"), ("d", 3, "p-2", "paragraph", "注册资本：____")]
    n = spark.createDataFrame(rows, "doc_id string, pos long, node_id string, kind string, text string")
    c = spark.createDataFrame([("d", "c", 0, 9)], "doc_id string, candidate_id string, start_pos long, end_pos long")
    form = spark.createDataFrame([("f", "address", "A"), ("f", "phone", "P"), ("f", "bidderName", "B"), ("f", "email", "")], "form_id string, field string, value string")
    plans = spark.createDataFrame([("d", "c", "f"), ("other", "c", "f")], "doc_id string, candidate_id string, form_id string")
    actions, unresolved = fillplan.form_targets(c, n, form, plans)
    assert {(r["label"], r["target_node_id"]) for r in actions.collect()} == {("address", "cell-0-0-1"), ("phone", "p-1")}
    assert [r["unknown_required"] for r in fillplan.plan_blockers(unresolved).collect()] == [1]
    extras = spark.createDataFrame([("f", "k1", "注册 资本", "1"), ("f", "k2", "没有", "2")], "form_id string, key string, label string, value string")
    actions, unresolved = fillplan.extra_targets(c, n, extras, plans)
    assert [(r["label"], r["target_node_id"]) for r in actions.collect()] == [("注册 资本", "p-2")]
    assert [r["field"] for r in unresolved.collect()] == ["k2"]
    assert [(r["label"], r["n"]) for r in templates.detected_slots(c, n).collect()] == [("注册资本", 1)]


def _docx(**changed) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    entries = {
        "[Content_Types].xml": "<Types/>",
        "word/document.xml": f"<w:document {w}><w:body>{p('资格审查', '<w:pStyle w:val="a3"/>')}{p('正文')}<w:sdt><w:sdtContent>{p('控件')}</w:sdtContent></w:sdt><w:tbl><w:tr><w:tc>{p('地址')}</w:tc><w:tc>{p('')}</w:tc></w:tr></w:tbl><w:ins w:author='Ann' w:date='2020-01-01T00:00:00Z'/></w:body></w:document>",
        "word/styles.xml": f"<w:styles {w}><w:style w:styleId='a3'><w:name w:val='heading 2'/></w:style></w:styles>",
        "word/header1.xml": f"<w:hdr {w}>{p('页眉')}</w:hdr>",
        "docProps/core.xml": "<c xmlns:dc='dc'><dc:creator>Ann</dc:creator><revision>3</revision></c>",
        "docProps/custom.xml": "<p><property><ui1>7</ui1></property><property><blob>x</blob></property></p>",
    }
    entries.update(changed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            if v is not None:
                z.writestr(k, v)
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx())
    (tmp_path / "b.docx").write_bytes(b"PK broken")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "d.pdf").write_bytes(b"none")
    (tmp_path / "e.txt").write_bytes(b"x")
    snap = {r["display_name"]: r["error_code"] for r in files.file_snapshots(spark, str(tmp_path)).collect()}
    assert snap == {"a.docx": None, "b.docx": None, "c.pdf": None, "d.pdf": "INVALID_DOCUMENT", "e.txt": "UNSUPPORTED_TYPE"}
    parts, rejects = files.docx_parts(files.read_packages(spark, str(tmp_path)))
    assert [r["error_code"] for r in rejects.collect()] == ["INVALID_DOCUMENT"]
    assert [r["name"] for r in parts.orderBy("ord").collect()][0] == "[Content_Types].xml"
    n, s = files.docx_nodes(parts)
    got = [(r["node_id"], r["kind"], r["level"], r["text"]) for r in files.with_headings(n, s).orderBy("pos").collect()]
    assert got == [("p-0", "heading", 2, "资格审查"), ("p-1", "paragraph", None, "正文"), ("p-2", "paragraph", None, "控件"), ("cell-0-0-0", "cell", None, "地址"), ("cell-0-0-1", "cell", None, ""), ("header-5", "header", None, "页眉")]
    occ = {(r["field"], r["action"], r["original_value"]) for r in files.docx_metadata(parts).collect()}
    assert occ == {("core:creator", "randomize", "Ann"), ("core:revision", "randomize", "3"), ("custom:property", "randomize", "7"), ("custom:property", "warn", "x"), ("word:author", "randomize", "Ann"), ("word:date", "randomize", "2020-01-01T00:00:00Z")}
    assert package.package_kind(parts).first()["error_code"] is None


def test_docx_parts_of_many_packages_together(spark):
    """Small packages share a batch, a broken one takes none of the others' rows with it, and no group is made for a document."""
    good, bad = _docx(), _docx()[:-30]
    df = spark.createDataFrame([(f"d{i:03}", good if i % 5 else bad) for i in range(300)], "doc_id string, content binary").coalesce(1)

    parts, rejects = files.docx_parts(df)
    n = len(zipfile.ZipFile(io.BytesIO(good)).namelist())
    assert {r["doc_id"]: r["count"] for r in parts.groupBy("doc_id").count().collect()} == {f"d{i:03}": n for i in range(300) if i % 5}
    assert sorted(r["doc_id"] for r in rejects.collect()) == [f"d{i:03}" for i in range(0, 300, 5)]
    nodes = files.docx_nodes(parts)[0]
    assert "FlatMapGroups" not in nodes._jdf.queryExecution().executedPlan().toString()
    pos = {r["doc_id"]: sorted(r["p"]) for r in nodes.groupBy("doc_id").agg(F.collect_list("pos").alias("p")).collect()}
    assert len(pos) == 240 and all(p == list(range(6)) for p in pos.values())


def test_docx_texts_are_whole(spark):
    """Paragraphs, cells and headers of more than 10,000 characters keep all of them."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text: f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"
    long = ["甲" * 25_000 + "尾", "b" * 10_001, "c" * 12_000 + "d"]
    body = f"<w:document {w}><w:body>{p(long[0])}<w:tbl><w:tr><w:tc>{p(long[1])}</w:tc></w:tr></w:tbl></w:body></w:document>"
    rows = [("a", 0, "word/document.xml", body.encode()), ("a", 1, "word/header1.xml", f"<w:hdr {w}>{p(long[2])}</w:hdr>".encode())]
    parts = spark.createDataFrame(rows, "doc_id string, ord int, name string, contents binary")
    assert [r["text"] for r in files.docx_nodes(parts)[0].orderBy("pos").collect()] == long


def test_unsafe_parts_and_kind(spark):
    rows = [("a", n, f, m, s, c) for n, f, m, s, c in [("ok.xml", 0, 0o100644, 10, 10), ("../x", 0, 0, 1, 1), ("/abs", 0, 0, 1, 1), ("C:x", 0, 0, 1, 1), ("a\\b", 0, 0, 1, 1), ("enc", 1, 0, 1, 1), ("ln", 0, 0o120777, 1, 1), ("big", 0, 0, 300 << 20, 300 << 20), ("bomb", 0, 0, 1000, 1)]]
    df = spark.createDataFrame(rows, "doc_id string, name string, flags int, mode int, size long, compressed_size long")
    got = {r["name"]: r["reason"] for r in package.unsafe_parts(df).collect()}
    assert got == {"../x": "path", "/abs": "path", "C:x": "path", "a\\b": "path", "enc": "encrypted", "ln": "symlink", "big": "entry-size", "bomb": "ratio"}
    base = ["word/document.xml", "[Content_Types].xml"]
    kinds = {"good": base, "none": ["x"], "macro": [*base, "word/vbaProject.bin"], "signed": [*base, "_xmlsignatures/sig1.xml"]}
    df = spark.createDataFrame([(k, n) for k, v in kinds.items() for n in v], "doc_id string, name string")
    assert {r["doc_id"]: r["error_code"] for r in package.package_kind(df).collect()} == {"good": None, "none": "INVALID_DOCUMENT", "macro": "MACRO_ENABLED", "signed": "SIGNED_DOCUMENT"}


def test_outline_levels(spark):
    n = spark.createDataFrame([("d", "s1", 3), ("d", "s1", None), ("d", "s2", None), ("d", "s3", None), ("d", "Heading4", None), ("d", None, None), ("d", "x", 9)], "doc_id string, style_id string, outline int")
    s = spark.createDataFrame([("d", "s1", "标题 2", None), ("d", "s2", "Title", None), ("d", "s3", "Body", 4)], "doc_id string, style_id string, name string, outline int")
    assert sorted((str(r["style_id"]), r["level"] or 0) for r in nodes.outline_levels(n, s).collect()) == [("Heading4", 4), ("None", 0), ("s1", 2), ("s1", 4), ("s2", 1), ("s3", 5), ("x", 0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ag3_finding_counts", "t3_finding_rows", "flt16_filter_findings", "jn2_missing_response", "tk2_per_key_limits"])
def test_pairs_are_not_broadcast(spark, sf, name):
    """Staged pairs in a small file may be many rows: their join does not rest on the size of the file."""
    assert "BroadcastExchange" not in _plan(queries()[name](spark, sf))


def _mismatch_inputs(spark):
    """Pairs and facts in files of a few kB: more than one bid of a tender, a kind on one side only, several facts of a kind."""
    rows = []
    for d in range(40):
        tender = [f"工期：{d}天", "工期：1天", "质量标准：合格"]
        bid = [f"工期：{d + (d % 4 == 0)}天", "质量标准：合 格" if d % 3 else "质量标准：不合格", "标段名称：A"]
        rows += [(f"{side}{d}", i, f"{side}{i}", "paragraph", t) for side, texts in (("t", tender), ("b", bid)) for i, t in enumerate(texts)]
    n = spark.createDataFrame(rows, "doc_id string, pos long, node_id string, kind string, text string")
    pairs = [(f"p{d}", f"t{d}", f"b{d}", "x") for d in range(40)] + [("again", "t0", "b1", "x"), ("none", None, "b1", "x"), ("gone", "t1", "b99", "x")]
    return stage(spark.createDataFrame(pairs, "pair_id string, tender_id string, bid_id string, bidder_name string"), "pairs"), stage(n, "nodes")


def test_mismatch_reads_one_exchange(spark):
    """No side is broadcast, and facts that were not staged are worked out and dealt by document once for both sides."""
    pairs, n = _mismatch_inputs(spark)
    d = review.fixed_mismatch(pairs, facts.extract_facts(n))
    assert "BroadcastExchange" not in _plan(d)
    got = sorted((r["pair_id"], r["summary"]) for r in d.collect())
    line = lambda label, t, b: f"{label}不一致：招标文件为“{t}”，投标文件为“{b}”。"
    want = [(f"p{d}", line("工期/服务期/交货期", f"{d}天", f"{d + 1}天")) for d in range(0, 40, 4)] + [(f"p{d}", line("质量标准", "合格", "不合格")) for d in range(0, 40, 3)] + [("again", line("工期/服务期/交货期", "0天", "1天"))]
    assert [p for p, _ in got] == [p for p, _ in sorted(want)] and {s for _, s in got} == {s for _, s in want}
    final = _plan(d).split("Initial Plan")[0]
    assert final.count("MapInArrow") == 1 and "ReusedExchange" in final
    assert "ObjectHashAggregate" not in final and not re.search(r"SortAggregate[^\n]*\n[^\n]*\bSort \[doc_id", final)  # rows sorted for their numbers are not sorted again


def test_finding_limits(spark):
    pairs = spark.createDataFrame([("p", "t", "b", "甲 公司")], "pair_id string, tender_id string, bid_id string, bidder_name string")
    n = _nodes(spark, [f"投标人：公司{i}" for i in range(15)], "b").unionByName(_nodes(spark, ["投标人：甲公司", "资格要求"], "t"))
    f = review.deterministic_findings(pairs, n.filter("doc_id = 't'"), n.filter("doc_id = 'b'"), facts.extract_facts(n)).collect()
    got = {r["type"]: r for r in f}
    assert set(got) == {"multiple-bidder-names", "missing-response"}
    names = got["multiple-bidder-names"]
    assert len(names["bid_evidence"]) == 10 and names["severity"] == "error" and names["confidence"] == 0.98 and names["summary"].endswith("甲 公司")
    assert all(re.fullmatch("[0-9a-f]{24}", r["id"]) for r in f)


def test_progress_rules(spark):
    rows = [("ok", "completed", "passed", 1.0, None), ("a", "completed", "failed", 1.0, None), ("b", "completed", "passed", 0.5, None), ("c", "failed", None, 0.5, None), ("d", "running", None, 2.0, "E")]
    df = spark.createDataFrame(rows, "task_id string, state string, verification_status string, progress double, error_code string")
    got = sorted((r["task_id"], r["rule"]) for r in quality.check_progress(df, ["task_id"]).collect())
    assert got == [("a", "completed-not-verified"), ("b", "completed-progress"), ("c", "failed-without-error"), ("d", "error-without-failure"), ("d", "progress-range")]


def test_read_diagnostics(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","detailId":"x","stage":"read"}\nnot json\n{"timestamp":"2024-01-01T00:00:00Z","detailId":"y","stage":"other"}\n')
    assert [r["detailId"] for r in files.read_diagnostics(spark, str(tmp_path)).collect()] == ["x"]


def test_streams(spark, tmp_path):
    spark.sql("SELECT 't' AS task_id, '1' AS plan_digest, TIMESTAMP '2024-01-01 00:00:00' AS created_at, 0 AS blockers UNION ALL SELECT 'u', '1', TIMESTAMP '2024-01-01 00:00:00', 0").write.parquet(str(tmp_path / "p"))
    spark.sql("SELECT 't' AS task_id, '1' AS plan_digest, TIMESTAMP '2024-01-01 00:20:00' AS ts UNION ALL SELECT 'u', '1', TIMESTAMP '2024-01-01 00:40:00'").write.parquet(str(tmp_path / "c"))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    q = logs.valid_confirmations(read("c"), read("p")).writeStream.format("memory").queryName("confirmed").option("checkpointLocation", str(tmp_path / "k")).start()
    try:
        q.processAllAvailable()
        assert [r["task_id"] for r in spark.table("confirmed").collect()] == ["t"]
    finally:
        q.stop()


def test_missing_nodes_without_gathering_a_document(spark):
    pairs = spark.createDataFrame([("p", "T", "B"), ("q", "T", "none"), ("r", "T", "nulls")], "pair_id string, tender_id string, bid_id string")
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(400))
    texts = ["ab", "a", "", None, long[250:280], long[-18:], "Ab  c", "x" * 18 + "tail differs", "资格 要求", "cdef"]
    required = _nodes(spark, texts, "T")
    bids = _nodes(spark, [long, "ABC", "x" * 20, None, "de", "f资格要求"], "B").union(_nodes(spark, [None], "nulls"))
    out = review.missing_nodes(pairs, required, bids, most=None)
    got = {(r["pair_id"], r["pos"]) for r in out.collect()}
    assert got == {("p", 3), ("p", 9)} | {("q", i) for i in range(10)} | {("r", i) for i in range(10) if i != 2}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_join" not in plan


def test_missing_nodes_by_all_pairs(spark):
    """Many keys of all lengths over few letters, also across the pieces of long texts."""
    rng = np.random.default_rng(8)
    text = lambda n, k: "".join(rng.choice(list("abc项目"[:k]), n))
    bids = [("B" if i % 2 else "C", text(rng.integers(0, 60), 2 + i % 4)) for i in range(60)] + [("B", text(70_000, 5))]
    need = [text(rng.integers(0, 25), 2 + i % 4) for i in range(300)] + [bids[-1][1][65_525:65_550], bids[-1][1][-18:]]
    pairs = spark.createDataFrame([("p", "T", "B"), ("q", "T", "C")], "pair_id string, tender_id string, bid_id string")
    nodes = spark.createDataFrame([(d, i, f"n{i}", t) for i, (d, t) in enumerate(bids)], "doc_id string, pos long, node_id string, text string")
    got = {(r["pair_id"], r["pos"]) for r in review.missing_nodes(pairs, _nodes(spark, need, "T"), nodes, most=None).collect()}
    assert got == {(p, i) for p, d in (("p", "B"), ("q", "C")) for i, t in enumerate(need) if not any(t[:18] in x for y, x in bids if y == d)}


def test_missing_nodes_of_many_bids(spark, monkeypatch):
    """The stream of a bid's rows finds what the index finds, stages nothing and shuffles no sampled windows."""
    rng = np.random.default_rng(9)
    text = lambda n, k: "".join(rng.choice(list("ab项目 ："[:k]), n))
    nodes = [(f"B{rng.integers(0, 8)}", i, f"n{i}", text(rng.integers(0, 40), 2 + i % 5) if i % 9 else None) for i in range(90)]
    need = [(f"T{i % 4}", i, f"r{i}", text(rng.integers(0, 9), 2 + i % 5) if i % 31 else None) for i in range(200)]
    pairs = [(f"p{i}", f"T{i % 4}", f"B{i}" if i < 10 else None) for i in range(11)]
    schema = "doc_id string, pos long, node_id string, text string"
    run = lambda: review.missing_nodes(spark.createDataFrame(pairs, "pair_id string, tender_id string, bid_id string"), spark.createDataFrame(need, schema), spark.createDataFrame(nodes, schema), most=None)
    few = sorted(map(tuple, run().collect()), key=repr)
    monkeypatch.setattr(review, "FEW_BIDS", 0)
    monkeypatch.setattr(review, "stage", None)
    many = run()
    assert sorted(map(tuple, many.collect()), key=repr) == few and 100 < len(few) < 550
    norm = lambda t: normalize_value(t)[:18] if t is not None else None
    held = lambda bid, k: k is not None and any(b == bid and (k == "" or (t is not None and k in normalize_value(t))) for b, _, _, t in nodes)
    assert few == sorted(((p, i, r, x) for p, t, b in pairs for d, i, r, x in need if d == t and not held(b, norm(x))), key=repr)


def test_facts_are_found_where_the_nodes_are(spark):
    """One shuffle, by document, and no join of texts."""
    d = facts.extract_facts(_nodes(spark, ["工期：30天", "工期：３１ 天；质量标准：Ａ（b）"]), counted=True)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert [(r["kind"], r["ord"], r["normalized"], r["of"]) for r in d.orderBy("kind", "ord").collect()] == [("duration", 0, "30天", 2), ("duration", 1, "31天", 2), ("quality", 0, "a(b)", 1)]


def test_form_slots_by_each_field(spark):
    """The rows left out first are slots of no field, and few rows meet the fields' patterns."""
    texts = ["地址：____", "　地 址　", "地址", "x 地址: 填写", "x地址：____", "EMAIL", "e-mail ：<a>", "Tel", "规格：____", "a:b", "", None, "地址", "电话|手机：待填写", "标段 名称", "ſ"]
    n = _nodes(spark, texts)
    got = {(r["node_id"], r["field"]) for r in templates.form_slots(n, templates.FORM_FIELDS).collect()}
    want = {(r["node_id"], f) for f in templates.FORM_FIELDS for r in n.filter(templates.form_slot(F.col("text"), f)).collect()}
    assert got == want and len(got) > 8
    plan = templates.form_slots(n, ["address"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Filter")


def _permutation(index, side, key, rounds=4):
    left, right = divmod(index, side)
    for i in range(rounds):
        step = int(hashlib.sha256(f"{key}:{i}:{right}".encode()).hexdigest()[:12], 16)
        left, right = right, (left + step) % side
    return left * side + right


def test_permutation_hits_every_number_once(spark):
    got = spark.range(26**4).select(keyed.permuted(F.col("id"), 26**2, F.lit("k")).alias("x"))
    assert got.agg(F.min("x"), F.max("x"), F.count_distinct("x")).first() == (0, 26**4 - 1, 26**4)
    for side, key in [(1, "a"), (2, "b"), (7, "c")]:
        got = [r["x"] for r in spark.range(side * side).select(keyed.permuted(F.col("id"), side, F.lit(key)).alias("x"), "id").orderBy("id").collect()]
        assert got == [_permutation(i, side, key) for i in range(side * side)] and sorted(got) == list(range(side * side))


def _occurrences(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, replacement_kind string, original_value string").withColumn("action", F.lit("randomize"))


def _aliases(spark, rows, **options):
    return [r.asDict() for r in metadata.aliases(_occurrences(spark, rows), b"s", 1_700_000_000, **options).collect()]


def test_initials_of_a_large_scope_are_distinct(spark):
    letters = F.concat(*[F.char((65 + F.floor(F.col("id") / F.lit(26**i)) % 26).cast("int")) for i in (3, 2, 1, 0)])
    occ = lambda n: spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("initials").alias("replacement_kind"), F.when(F.col("id") < 26**4, letters).otherwise(F.col("id").cast("string")).alias("original_value"), F.lit("randomize").alias("action"))
    for n in (400_000, 26**4):  # the second needs every alias there is, each also an original
        got = metadata.aliases(occ(n), b"s", 1_700_000_000)
        row = got.agg(F.count(F.lit(1)), F.count_distinct("alias"), F.count_if(F.col("alias") == F.col("original_value")), F.count_if(F.col("alias").rlike("^[A-Z]{4}\\z")), F.count("error_code")).first()
        assert row == (n, n, 0, n, 0)
    row = metadata.aliases(occ(26**4 + 1), b"s", 1_700_000_000).agg(F.count(F.lit(1)), F.count("alias"), F.count_if(F.col("error_code") == "ALIASES_EXHAUSTED")).first()
    assert row == (26**4 + 1, 0, 26**4 + 1)


def test_enumerations_exchange_originals(spark):
    """All sets of originals over a few words, in many scopes: every alias another word of the list, none twice."""
    words = ["True", "False", "Unknown"]
    sets = [[w for i, w in enumerate([*words, "other"]) if bits >> i & 1] for bits in range(1, 16)]
    rows = [(f"{k}-{j}", "trapped", w) for j, s in enumerate(sets) for k in range(20) for w in s]
    got = {}
    for r in _aliases(spark, [*rows, *rows[:9], (None, "trapped", "True"), (None, "trapped", None)]):
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 20 * 15 + 1 and len(got[None]) == 2
    for d, g in got.items():
        names = [r["alias"] for r in g]
        if len(g) > 3:
            assert names == [None] * 4 and {r["error_code"] for r in g} == {"ALIASES_EXHAUSTED"}
        else:
            assert set(names) <= set(words) and len(set(names)) == len(g) and all(r["alias"] != r["original_value"] and r["error_code"] is None for r in g)
    one = _aliases(spark, [("d", "state", "on"), ("e", "state", "x")], enums={"state": ["on"]})
    assert {(r["doc_id"], r["alias"], r["error_code"]) for r in one} == {("d", None, "ALIASES_EXHAUSTED"), ("e", "on", None)}
    with pytest.raises(ValueError):
        _aliases(spark, rows[:1], enums={"trapped": ["True", ""]})


def test_aliases_do_not_depend_on_row_order(spark):
    rows = [("d", k, f"v{i}") for i in range(50) for k in ("initials", "person", "timestamp")]
    key = lambda g: {(r["kind"], r["original_value"]): r["alias"] for r in g}
    a, b = _aliases(spark, rows), _aliases(spark, rows[::-1] + rows[:7])
    assert key(a) == key(b) and len(a) == 150
    assert _aliases(spark, []) == []
    c = metadata.aliases(_occurrences(spark, rows), b"other", 1_700_000_000).collect()
    assert sum(key(a)[r["kind"], r["original_value"]] == r["alias"] for r in c) < 5


def test_bounded_integers_and_times(spark):
    rows = [("d", f"integer:{lo}:{hi}", str(v)) for lo, hi in [(-128, 127), (0, 1), (5, 5), (-(2**31), 2**31 - 1)] for v in [lo, hi, (lo + hi) // 2]]
    for r in _aliases(spark, rows):
        _, lo, hi = r["kind"].split(":")
        assert int(lo) <= int(r["alias"]) <= int(hi) and (r["alias"] != r["original_value"] or lo == hi)
    got = _aliases(spark, [("d", "timestamp", f"t{i}") for i in range(2000)])
    times = [datetime.fromisoformat(r["alias"]).timestamp() for r in got]
    assert len({r["alias"] for r in got}) == 2000 and 1_700_000_000 - 365 * 86400 <= min(times) and max(times) <= 1_700_000_000


def test_exhausted_aliases_leave_the_plan_expired(spark):
    occ = _occurrences(spark, [("d", "trapped", w) for w in ("True", "False", "Unknown", "x")] + [("e", "trapped", "True")]).withColumn("part", F.lit("p")).withColumn("locator", F.col("original_value"))
    out = metadata.apply_replacements(occ, metadata.plan_replacements(occ, metadata.aliases(occ, b"s", 1_700_000_000))).collect()
    assert {(r["doc_id"], r["error_code"]) for r in out} == {("d", "PLAN_EXPIRED"), ("e", None)}
