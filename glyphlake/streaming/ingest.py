"""Incremental index maintenance as streams (I1, I4, I5, S17): batches of additions and removals, and new image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphlake.operators.bow import normalize, transform


def events_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of (action, image_id, word_id, n, ts) rows from files."""
    return spark.readStream.schema(schema).parquet(path)


def image_stream(spark: SparkSession, path: str, extension: str = ".jpg") -> DataFrame:
    """Image files as they arrive."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(path)


def latest_actions(events: DataFrame, key: str = "image_id") -> DataFrame:
    """The last action on each image, by time and then event id: what a batch of additions and removals comes to."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def maintain(words: DataFrame, weights: DataFrame, log: str, checkpoint: str, weighting: str = "tf_idf") -> StreamingQuery:
    """Append each micro-batch of word occurrences (image_id, word_id, n) to a log of postings under ``log``.

    Weights are frozen, so an addition never changes other images' vectors and an append is all there is to do; rows carry
    the batch, so that a batch written twice after a failure replaces itself.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        bow = normalize(transform(batch, weights, weighting))
        out = bow.select("word_id", "image_id", F.col("value").alias("weight"))
        out.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    return words.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Actions by window and kind, late rows within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
