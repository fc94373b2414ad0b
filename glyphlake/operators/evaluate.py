"""Evaluation (E1-E4): groups of consecutive images as ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.scalars import group_start


def group_score(matches: DataFrame, size: int = 4) -> DataFrame:
    """(query_id, group_score): how many of the first ``size`` results are of the query's group, itself included; fewer results count as they are."""
    hit = (F.col("rank") <= size) & (group_start(F.col("query_id"), size) == group_start(F.col("image_id"), size))
    return matches.groupBy("query_id").agg(F.sum(hit.cast("long")).alias("group_score"))


def mean_score(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """One row, mean_score over all requested queries (query_id); those without results count as 0."""
    both = queries.select("query_id").distinct().join(scores, "query_id", "left")
    return both.agg(F.avg(F.coalesce("group_score", F.lit(0))).alias("mean_score"))


def ground_truth(images: DataFrame, size: int = 4, width: int = 5) -> DataFrame:
    """(query, results): each image's name and those of the rest of its group in order, padded with zeros."""
    name = lambda c: F.lpad(F.col(c).cast("string"), width, "0")
    one = images.select(F.col("image_id").alias("q"), group_start(F.col("image_id"), size).alias("g"))
    two = images.select(F.col("image_id").alias("r"), group_start(F.col("image_id"), size).alias("g"))
    pairs = one.join(two, "g").where("q <> r").select(name("q").alias("query"), name("r").alias("r"))
    return pairs.groupBy("query").agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("results"))
