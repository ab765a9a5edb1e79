"""Files and archives read by the Python data sources: rows of odd files, limits, pruning, agreement with the readers of whole files."""

from __future__ import annotations

import hashlib
import io
import os
import random
import zipfile

from pyspark.sql import functions as F

from paperloom.plans.corpora import write_files
from paperloom.sources import archives, files


def _zip(entries: dict[str, bytes], method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, contents in entries.items():
            z.writestr(name, contents)
    return out.getvalue()


def _wrong_byte(content: bytes, name: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        at = z.getinfo(name).header_offset + 30 + len(name) + 5
    return content[:at] + bytes([content[at] ^ 1]) + content[at + 1 :]


def _rows(df, *cols):
    return {tuple(os.path.basename(v) if c in ("doc_id", "path") else v for c, v in zip(cols, r, strict=True)) for r in df.select(*cols).collect()}


def test_digests_equal_those_of_whole_files(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    big = b"%PDF-" + random.Random(1).randbytes((2 << 20) + 77)
    cases = {"a.docx": b"PK\x03\x04x", "deep/b.pdf": big, "deep/er/c.PDF": b"%PDF", "d.docx": b"", "e": b"PK", "f g.tar.docx": b"pk", "名.pdf": b"%PDF-1.7"}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    cols = ["display_name", "document_type", "size", "sha256", "mtime_ms", "error_code"]
    got = _rows(archives.digest_files(spark, str(tmp_path)), *cols)
    assert {r for r in got if r[0] != "d.docx"} == _rows(files.file_snapshots(spark, str(tmp_path)), *cols)  # Spark's reader gives no empty files
    assert {(n, s) for n, _, _, s, _, _ in got} == {(k.split("/")[-1], hashlib.sha256(v).hexdigest()) for k, v in cases.items()}
    # a file over the limit is listed, not opened: it may not even be readable
    small = archives.digest_files(spark, str(tmp_path), max_file=100)
    assert _rows(small.filter("size > 100"), "display_name", "sha256", "error_code") == {("b.pdf", None, "FILE_TOO_LARGE")}
    assert _rows(archives.digest_files(spark, str(tmp_path), pattern="*.pdf"), "display_name") == {("b.pdf",), ("c.PDF",), ("名.pdf",)}


def test_empty_folder(spark, tmp_path):
    assert archives.digest_files(spark, str(tmp_path)).count() == 0
    assert archives.archive_parts(spark, str(tmp_path)).count() == 0


def test_archives_agree_with_whole_files(spark, tmp_path):
    text = random.Random(2).randbytes(70_000)
    whole = _zip({"[Content_Types].xml": b"<Types/>", "word/document.xml": text, "word/media/": b"", "empty": b""})
    cases = {
        "whole.docx": whole, "stored.docx": _zip({"a": text, "b": b"x"}, zipfile.ZIP_STORED), "cut.docx": whole[: len(whole) // 2], "byte.docx": _wrong_byte(whole, "word/document.xml"), "text.docx": b"PK broken",
        "empty.docx": b"", "none.docx": _zip({}), "before.docx": b"junk" * 50 + whole, "after.docx": whole + b"junk", "other.pdf": whole, "many.docx": _zip({f"p{i}": b"" for i in range(10_001)}),
    }
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    cols = ["doc_id", "ord", "name", "contents", "is_dir", "method", "flags", "mode", "size", "compressed_size"]
    both = archives.archive_parts(spark, str(tmp_path)).cache()
    parts, rejects = files.docx_parts(files.read_packages(spark, str(tmp_path)))
    assert _rows(both.filter("error_code is null"), *cols) == _rows(parts, *cols)
    assert _rows(both.filter("error_code is not null"), "doc_id") == _rows(rejects, "doc_id") | {("empty.docx",)} == {(f"{x}.docx",) for x in ("cut", "byte", "text", "empty", "many")}
    assert both.filter("error_code is not null").count() == 5
    # parts of an archive come in its order
    got = [r["name"] for r in both.filter(F.col("doc_id").endswith("/whole.docx")).collect()]
    assert got == ["[Content_Types].xml", "word/document.xml", "word/media/", "empty"]


def test_limits_and_pruning(spark, tmp_path):
    good = _zip({"word/document.xml": b"d" * 5000, "word/media/a.png": b"p" * 50_000, "docProps/core.xml": b"c"})
    (tmp_path / "a.docx").write_bytes(_wrong_byte(good, "word/media/a.png"))
    (tmp_path / "b.docx").write_bytes(good + b"x" * 9000)
    xml = archives.archive_parts(spark, str(tmp_path), names="\\.xml$", max_file=8000)
    assert _rows(xml, "doc_id", "ord", "size", "error_code") == {("a.docx", 0, 5000, None), ("a.docx", 2, 1, None), ("b.docx", None, None, "FILE_TOO_LARGE")}
    small = archives.archive_parts(spark, str(tmp_path), max_entry=6000)
    got = {(r["name"], r["contents"] is None) for r in small.filter(F.col("doc_id").endswith("/b.docx")).collect()}
    assert got == {("word/document.xml", False), ("word/media/a.png", True), ("docProps/core.xml", False)}
    assert _rows(archives.archive_parts(spark, str(tmp_path)).filter("error_code is not null"), "doc_id") == {("a.docx",)}


def test_large_archives_are_checked_before_parts_come(tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "BATCH", 1000)
    entries = {f"p{i}": random.Random(i).randbytes(400) for i in range(6)} | {"wide": b"w" * 5000, "last": b"z" * 10}
    good = _zip(entries)
    for content, broken in ((good, False), (_wrong_byte(good, "p5"), True), (_wrong_byte(good, "p0"), True)):
        (tmp_path / "x.docx").write_bytes(content)
        reader = archives._EntryReader({"path": str(tmp_path)})
        batches = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
        rows = [r for b in batches for r in b]
        if broken:
            assert [r["error_code"] for r in rows] == ["INVALID_DOCUMENT"]
        else:
            assert {r["name"]: r["contents"] for r in rows} == entries and [r["ord"] for r in rows] == list(range(8))
            assert all(sum(len(r["contents"]) for r in b[:-1]) <= 1000 for b in batches)


def test_files_are_dealt_by_size(tmp_path):
    for i in range(20):
        (tmp_path / f"{i:02}.docx").write_bytes(b"x" * (300_000 if i == 3 else 10))
    reader = archives._EntryReader({"path": str(tmp_path), "split_bytes": "200000"})
    parts = reader.partitions()
    assert sorted(f[0][-7:] for p in parts for f in p.files) == [f"{i:02}.docx" for i in range(20)]
    assert max(len(p.files) for p in parts) == 4 and len(parts) > 4


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", bytes([i] * i)) for i in range(40)], "name string, content binary")
    for _ in range(2):  # written again, as after a lost executor: the same files
        assert write_files(rows, f"file://{tmp_path}") == 40
    got = _rows(archives.digest_files(spark, f"file://{tmp_path}/files"), "display_name", "size")
    assert got == {(f"n{i}", i) for i in range(40)}
    assert not os.listdir(tmp_path / "unfinished")
