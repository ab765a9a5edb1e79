"""A corpus pipeline: documents in, packed training sequences out.

Stages, each over all rows its predecessor kept, written as Parquet in between:

1. quality classifier: documents it rejects go;
2. line dedup: repeated runs are cut from the texts, documents left without a word go;
3. near-duplicates: one document of each group stays;
4. mixing: sources are brought to their target weights by repetition, nothing is dropped;
5. packing: the pieces of the mixture's documents in sequences of at most 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from paperloom.llm.common import stage, table

#: No SQL can state the classifier or the packing; tests compare the stages with plain versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, max_repeats=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a document the mixture repeats is packed once for each copy
    pieces = packing.tokenize(docs.select("doc_id", "text"), keep_ids=False)
    return packing.pack(stage(pieces, "pieces"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


