from __future__ import annotations

from paperloom.llm import quality_rules
from paperloom.llm.queries import op4

from .brute import base_counts

EDGE = [
    None, "", " ", "\n\n", "a", "a\tb\vc\fd\re f", "one word here", "x " * 50, "a b c d e f g h a b c d e f g h",
    "a b c d e f g h i\nz z\na b c d e f g h i\nz z\n \nz z", "😀 😀 |$# <>", " lead and trail ", "w" * 20000, "l i n e\r\nl i n e\r\n",
]


def _check(rows):
    for r in rows:
        want = base_counts(r["text"])
        assert {k: r[k] for k in want} == want, r["text"]
        if r["base_failed"]:
            assert not r["kept"]


def test_edges(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(EDGE)] + [(None, "a b", 1)], "doc_id long, text string, n_words long")
    _check(quality_rules.clean_lines(df).collect())
    assert quality_rules.clean_lines(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    _check(op4(spark, sf).join(docs, "doc_id").collect())


def test_lines(spark):
    prose = "The clerk read the letter aloud and then put it back into the drawer, where it stayed."
    other = "Nobody else in the office had seen it, so nobody asked him what it said or who had sent it."
    nav = "Home | News | Sport | Shop | Contact | Help"
    df = spark.createDataFrame([(1, "\n".join([prose, nav, other]))], "doc_id long, text string")
    got = quality_rules.clean_lines(df).first()
    assert got["cleaned_text"] == prose + "\n" + other and got["kept"]
    df = spark.createDataFrame([(1, "\n".join([prose] + [f"{nav} {i} | a{i} | b{i}" for i in range(9)]))], "doc_id long, text string")
    assert not quality_rules.clean_lines(df).first()["kept"]


def test_clean_documents_stay(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {(r["quality"], r["kept"]): r["n"] for r in op4(spark, sf).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().withColumnRenamed("count", "n").collect()}
    assert kept.get((1, False), 0) <= 0.01 * kept[(1, True)]
