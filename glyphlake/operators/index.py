"""Inverted index as a table of postings (I1-I7): (word_id, image_id, weight), appended to, reduced by anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "word_id int, image_id long, weight double"


def empty_index(spark: SparkSession) -> DataFrame:
    """An index of nothing."""
    return spark.createDataFrame([], SCHEMA)


def build_index(bow: DataFrame, word: str = "word_id", image: str = "image_id") -> DataFrame:
    """Postings of all images of a bag-of-words table at once."""
    return bow.select(word, image, F.col("value").alias("weight"))


def add_images(postings: DataFrame, bow: DataFrame, word: str = "word_id", image: str = "image_id") -> DataFrame:
    """Postings with further images; images that are there already keep their postings and are not added again."""
    fresh = build_index(bow, word, image).join(postings.select(image).distinct(), image, "left_anti")
    return postings.select(word, image, "weight").unionByName(fresh.select(word, image, "weight"))


def remove_images(postings: DataFrame, gone: DataFrame, image: str = "image_id") -> DataFrame:
    """Postings without the images of ``gone``."""
    return postings.join(gone.select(image).distinct(), image, "left_anti")


def entries(postings: DataFrame, image: str = "image_id") -> DataFrame:
    """One row, entries: images in the index, counted anew after every removal."""
    return postings.agg(F.count_distinct(image).cast("long").alias("entries"))


def save_bucketed(postings: DataFrame, table: str, buckets: int, word: str = "word_id") -> None:
    """K5: the index as a table bucketed and sorted by word, so that searches join it without moving it."""
    postings.write.bucketBy(buckets, word).sortBy(word).mode("overwrite").saveAsTable(table)


def posting_lists(postings: DataFrame, word: str = "word_id", image: str = "image_id") -> DataFrame:
    """(word, entries) with each word's postings as a list, for export."""
    return postings.groupBy(word).agg(F.array_sort(F.collect_list(F.struct(image, "weight"))).alias("entries"))
