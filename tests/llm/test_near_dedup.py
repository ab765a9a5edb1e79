from __future__ import annotations

import random

from paperloom.llm import components, near_dedup
from paperloom.llm.queries import op8

from .brute import near


def _compare(df, rows, n):
    want = near([(r["doc_id"], r["text"]) for r in df.collect()], n, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == want
    return len({c for _, c in want.values()}), len(want)


def test_query_against_all_pairs(spark, sf):
    groups, n = _compare(spark.read.parquet(f"{sf}/documents.parquet"), op8(spark, sf).collect(), 2)
    assert groups < n


def test_edges_copies_and_borders(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE two"), (8, "É é"), (9, "é é"), (10, "a b c d e f"), (11, "a b c d e")]
    rows += [(20 + i, " ".join(base)) for i in range(30)]
    for i in range(120):  # a large group of near copies, some just under the threshold with each other
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n in (2, 5):
        _compare(df, near_dedup.near_duplicates(df, shingle=n).collect(), n)


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == 4 and {(r["doc_id"], r["kept"]) for r in rows} == {(None, True), (1, True), (2, False)}
    assert near_dedup.drop_near_duplicates(df).count() == 3
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7)] + [(1000, 1000 + i) for i in range(1, 300)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 150, 200)}, **{1000 + i: 1000 for i in range(300)}}


def _family(seed, edits, words=120):
    """Copies of one text; the i-th has `edits[i]` words of its own at random places."""
    rng, rows = random.Random(seed), []
    for i, e in enumerate(edits):
        copy = [f"w{k}" for k in range(words)]
        for k in rng.sample(range(words), e(rng) if callable(e) else e):
            copy[k] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    return rows


def test_links_among_many_borderline_copies(spark):
    df = spark.createDataFrame(_family(1, [lambda rng: rng.randint(7, 16)] * 400), "doc_id long, text string")
    _compare(df, near_dedup.near_duplicates(df, shingle=1).collect(), 1)


def test_region_larger_than_a_slice(spark):
    # nearly all are linked; some are on both sides of the threshold with very few others
    edits = [lambda rng: rng.choice((3, 4, 5)) if rng.random() < 0.95 else rng.randint(8, 16)] * 2300
    rows = _family(2, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    _compare(df, near_dedup.near_duplicates(df, shingle=1).collect(), 1)


def test_star_of_copies_linked_to_one_document_only(spark):
    # 2,000 words; the centre shares just over 80 % with each of the 1,500 others, which share about 67 % with each other
    rng = random.Random(9)
    base = [f"w{k}" for k in range(2000)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1501):
        copy = list(base)
        for k in rng.sample(range(2000), 222 if i % 10 else 223):  # 1778 / 2222 and 1777 / 2223 on both sides of 0.8
            copy[k] = f"x{i}-{k}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, shingle=1).collect()}
    assert got == {i: 0 if i % 10 else i for i in range(1501)} | {0: 0}


def test_names_of_the_engine_as_user_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4), (2, "a b c", 5, 6, 7, 8), (None, None, 9, 9, 9, 9)], "doc_id long, text string, _gone int, row int, set_key int, component_id int")
    out = near_dedup.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(map(repr, out.collect())) == sorted(map(repr, df.filter("doc_id is null or doc_id = 1").collect()))
