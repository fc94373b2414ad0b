"""The corpus pipeline: quality, near duplicates, personal data, mixing and packing, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces. Extra columns are
carried along untouched, whatever their names; null ids, texts and sources are allowed throughout, texts are read whole
whatever their length, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import mixing, neardup, packing, pii, quality
from glyphlake.llm.common import fold_of, staged, table, unstage, without

#: Tokens of a packed sequence; least quality score that stays; percentage of common shingles that links near duplicates.
CAPACITY = 2048
LEAST_QUALITY = 0.3
NEAR = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the classifier rejects go. It learns from the labels outside the held-out fold.

    Each row is judged by its own text, so equal rows go or stay alike; null and empty texts get the score of no features.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 5) != 0)
    return quality.score(docs, model, *docs.columns, name="_quality").where(F.col("_quality") >= LEAST_QUALITY).drop("_quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group one row stays, of the least id and there of the least hash of the text; rows of one id may
    have different texts, and each goes or stays by its own. Of rows without words (null, empty and blank texts), one of
    each id and text stays; rows of a null id all do. Equal rows are one group, of which one row stays."""
    keyed = docs.withColumn("_text_hash", F.xxhash64("text"))
    key = ["doc_id", "_text_hash"]
    groups = staged(neardup.rows_of_groups(keyed, NEAR, "_text_hash"), "groups")
    dropped = staged(groups.where(~F.col("kept")).select(*key).distinct(), "dropped")
    left = without(keyed, dropped, *key)
    repeated = staged(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    first = groups.where("kept and comp is not null").join(repeated, "doc_id", "left_semi").select(*key, "comp").distinct()
    least = first.groupBy("doc_id", "comp").agg(F.min("_text_hash").alias("_least"))
    later = staged(first.join(least, ["doc_id", "comp"]).where("_text_hash != _least").select(*key), "later")
    once = left.join(repeated, "doc_id", "left_semi").join(later, key, "left_anti").dropDuplicates(["doc_id", "text"])
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data in the texts is replaced by its kind; n_chars follows. All rows stay, equal ones alike; null
    and empty texts stay as they are, with 0 characters."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest")  # apart, so that no name clashes
    found = pii.identify(docs.select(rest, "text"), "_rest", "text")
    text = F.when(F.col("text").isNotNull() & (F.size("spans") > 0), pii.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    found = found.select("_rest", text.alias("text"))
    columns = {c: F.col("text") if c == "text" else F.col("_rest").getField(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return found.select(*[column.alias(c) for c, column in columns.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each document as often as the mix takes it; those without words (null, empty, blank) are copied like
    others and add none. Null sources are one source; of equal rows as many are taken as fit the target."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")  # apart, so that no name clashes
    taken = mixing.mix(docs.select(whole, "doc_id", "text", "source"), "_doc").where("copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the mix in sequences of at most CAPACITY tokens. A null or empty text is a piece of the end id alone; equal
    rows are packed as often as they occur; longer documents are cut, whatever their length."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the trained classifier, so no stage has a twin; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage but the last is written and read again, and deleted when the next
    one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
            if before is not None:
                unstage(before)
            before = docs
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
