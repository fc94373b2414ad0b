"""The registered query of each operator, and the DuckDB twin where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import fold_of, table
from glyphlake.llm.oracles import ORACLES as ORACLES


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048), 2048)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.language import fit, predict

    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 3) == 1)
    langs, log_prob = fit(docs, ~F.col("held_out"))
    return predict(docs, langs, log_prob, "doc_id", "held_out")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 4) == 2)
    model = fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 4) != 2)
    return score(docs, model, "doc_id", "held_out").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"), "page_id", "url")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.neardup import group

    return group(table(spark, sf_dir, "documents"), 85)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.pii import identify, spelled

    found = identify(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id"), 5) == 0)
    model = fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return score(docs, model, "doc_id", "held_out").withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from glyphlake.llm.rules import judged

    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_language_id,
        op3_toxicity,
        op4_fingerprints,
        op5_html_extraction,
        op6_near_dedup,
        op7_pii,
        op8_mixing,
        op9_quality,
        op10_quality_rules,
    )
}
