"""Bags of words (A2-A7, A9, A10, C6, P15): weights, stop words, transforms and normalisation.

Long tables (image_id, word_id, ...) throughout; a map of words exists only where a caller asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTINGS = ("tf", "idf", "tf_idf", "binary")


def document_frequency(words: DataFrame, word: str = "word_id", image: str = "image_id") -> DataFrame:
    """A10: (word, df), the number of images that contain the word at all."""
    return words.groupBy(word).agg(F.count_distinct(image).cast("long").alias("df"))


def image_count(words: DataFrame, image: str = "image_id") -> DataFrame:
    """One row, n: images with any word; images without features don't count."""
    return words.agg(F.count_distinct(image).cast("long").alias("n"))


def idf(df_table: DataFrame, n: int | Column, word: str = "word_id") -> DataFrame:
    """(word, idf) = ln(n / df). Words that occur nowhere have no row rather than an infinite weight."""
    n = F.lit(n) if isinstance(n, int) else n
    return df_table.where("df > 0").select(word, F.ln(n / F.col("df")).alias("idf"))


def word_weights(words: DataFrame, weighting: str = "tf_idf", word: str = "word_id", image: str = "image_id") -> DataFrame:
    """(word, weight): 1 for tf and binary, ln(N / df) for idf and tf_idf; words of weight 0 are stop words."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting!r}; one of {', '.join(WEIGHTINGS)}")
    if weighting in ("tf", "binary"):
        return words.select(word).distinct().withColumn("weight", F.lit(1.0))
    n = words.agg(F.count_distinct(image)).collect()[0][0]
    return idf(document_frequency(words, word, image), int(n), word).withColumnRenamed("idf", "weight")


def stop_words(weights: DataFrame) -> DataFrame:
    """The words that no vector keeps."""
    return weights.where("weight <= 0")


def transform(words: DataFrame, weights: DataFrame, weighting: str = "tf_idf", word: str = "word_id", image: str = "image_id") -> DataFrame:
    """A2-A4: (image, word, value) from rows of (image, word, n occurrences) and (word, weight).

    tf and tf_idf add the weight at each occurrence, idf and binary count the first alone; weights of 0 or less go.
    """
    kept = words.join(weights.where("weight > 0"), word)
    value = F.sum(F.col("n") * F.col("weight")) if weighting in ("tf", "tf_idf") else F.max("weight")
    return kept.groupBy(image, word).agg(value.alias("value"))


def normalize(bow: DataFrame, norm: str = "l1", image: str = "image_id", value: str = "value") -> DataFrame:
    """A5: values divided by the image's sum of magnitudes or its root of squares; images of norm 0 stay as they are.

    A window over the image: one exchange by image, which a table that comes from a groupBy on the image already has.
    """
    if norm not in ("l1", "l2"):
        raise ValueError(f"unknown norm {norm!r}; l1 or l2")
    own = Window.partitionBy(image)
    size = F.sum(F.abs(value)).over(own) if norm == "l1" else F.sqrt(F.sum(F.col(value) * F.col(value)).over(own))
    return bow.withColumn("_norm", size).withColumn(value, F.when(F.col("_norm") > 0, F.col(value) / F.col("_norm")).otherwise(F.col(value))).drop("_norm")


def histogram(assigned: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, word_id, n): descriptors of each image by their nearest word."""
    return assigned.groupBy(image, "word_id").agg(F.count("*").alias("n"))


def members(assigned: DataFrame, image: str = "image_id", kp: str = "kp_id") -> DataFrame:
    """(image, word_id, kps): which descriptors make up each count."""
    return assigned.groupBy(image, "word_id").agg(F.array_sort(F.collect_list(kp)).alias("kps"))


def as_map(bow: DataFrame, word: str = "word_id", image: str = "image_id") -> DataFrame:
    """(image, bow) with the vector as a map, for callers outside tables."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(word).alias("key"), F.col("value").alias("value"))))
    return bow.groupBy(image).agg(F.map_from_entries(pairs).alias("bow"))


def dense_lines(bow: DataFrame, words: int, image: str = "image_id") -> DataFrame:
    """(image, line): values of words 0..words-1 apart by spaces, 0 where a word is absent."""
    values = F.map_from_entries(F.collect_list(F.struct("word_id", "value")))
    grouped = bow.groupBy(image).agg(values.alias("_m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.format_string("%.4f", F.coalesce(F.try_element_at("_m", w), F.lit(0.0))))
    return grouped.select(image, F.array_join(cells, " ").alias("line"))
