"""Registered queries of the training-text operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ann, decontamination, line_dedup, merkle, mixing, near_dedup, oracles, packing, quality_classifier, quality_rules, sharding, spelling, suffix_dedup, toxicity
from .common import stage, table


def op2(spark, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), "kept_sha256")


def op4(spark, sf_dir: str) -> DataFrame:
    out = quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5(spark, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Per document: lines with words, lines removed, which (numbers from 0) and the sha256 of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.remove_lines(docs, line_dedup.repeated_lines(docs))
    gone = F.coalesce("removed_lines", F.array().cast("array<int>"))
    return out.select(
        "doc_id",
        F.size(gone).cast("long").alias("n_removed"),
        F.array_join(gone.cast("array<string>"), ",").alias("removed_lines"),
        F.length(F.coalesce("kept_text", F.lit(""))).cast("long").alias("n_kept_chars"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10(spark, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "epoch", "block", "mix_order")


def op9(spark, sf_dir: str) -> DataFrame:
    pieces = stage(packing.tokenize(table(spark, sf_dir, "documents"), keep_ids=False), "pieces")
    return packing.pack(pieces)


def op11(spark, sf_dir: str) -> DataFrame:
    return merkle.op11(table(spark, sf_dir, "documents"))


def op12(spark, sf_dir: str) -> DataFrame:
    return decontamination.op12(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13(spark, sf_dir: str) -> DataFrame:
    return spelling.op13(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_ann": op2,
        "op3_suffix_dedup": op3,
        "op4_quality_rules": op4,
        "op5_sharding": op5,
        "op6_quality_classifier": quality_classifier.op6,
        "op7_line_dedup": op7,
        "op8_near_dedup": op8,
        "op9_packing": op9,
        "op10_mixing": op10,
        "op11_merkle": op11,
        "op12_decontamination": op12,
        "op13_spelling": op13,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
