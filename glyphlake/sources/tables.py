"""Tables of images, descriptors and words, and staging between iterations."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(setting: str | None, master: str, application: str) -> str:
    """The folder of staged tables: ``spark.checkpoint.dir``, which only a local master may leave unset."""
    if setting:
        return setting.rstrip("/")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/glyphlake-{application}"


def _files(df: DataFrame, path: str):
    context = df.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder of ``spark.checkpoint.dir`` and read back: cuts lineage and survives lost executors.

    The table is deleted when the application ends, or before by ``unstage``.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = shared_folder(spark.conf.get("spark.checkpoint.dir", None), context.master, context.applicationId)
    path = f"{base}/glyphlake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    target, files = _files(df, path)
    files.deleteOnExit(target.getParent())
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        target, files = _files(df, df.staged_at)
        files.delete(target.getParent(), True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """While this holds, batches for Python have few rows: bags are long, and their buffers are memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def descriptors(df: DataFrame, vec: str = "embedding", key: str = "vec_id", per_image: int = 5) -> DataFrame:
    """(vec_id, image_id, kp_id, vec) of a table of vectors, ``per_image`` consecutive ids to an image; empty vectors go."""
    k = F.col(key)
    return df.where(F.size(vec) > 0).select(
        k.alias("vec_id"),
        F.floor(k / per_image).cast("long").alias("image_id"),
        (k % per_image).cast("int").alias("kp_id"),
        F.col(vec).cast("array<double>").alias("vec"),
        *[c for c in df.columns if c not in (vec, key)],
    )


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of texts in the role of visual words: (image_id, word, n)."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))
    return df.select(F.col(key).alias("image_id"), words.alias("word")).groupBy("image_id", "word").agg(F.count("*").alias("n"))


def token_bags(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of ``tokens``, a row for each id with any: (image_id, words, x), words apart by spaces and counts as 32-bit numbers.

    Staged. Texts of one id are read as one.
    """
    find = re.compile("[a-z]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(find(t.as_py() or "")) for t in batch.column("text")]
            words, n = [" ".join(c) for c in found], [np.fromiter(c.values(), "<i4", len(c)).tobytes() for c in found]
            yield pa.record_batch([batch.column("image_id"), pa.array(words, pa.string()), pa.array(n, pa.binary())], ["image_id", "words", "x"])

    rows = df.select(F.col(key).cast("long").alias("image_id"), F.lower(text).alias("text"))
    repeated = staged(rows.groupBy("image_id").agg(F.count("*").alias("n")).where("n > 1").select("image_id"), "repeated")
    if not repeated.isEmpty():
        same = rows["image_id"].eqNullSafe(repeated["image_id"])
        rows = rows.join(repeated, same, "left_anti").unionByName(rows.join(repeated, same, "left_semi").groupBy("image_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")))
    with small_batches(df.sparkSession):
        return staged(rows.mapInArrow(run, "image_id long, words string, x binary").where("words != ''"), "bags")


def number_images(paths: DataFrame, path: str = "path") -> DataFrame:
    """Ids 0.. in path order. Paths are numbered within ranges and ranges offset, so no task sorts them all."""
    spread = paths.select(path).distinct().repartitionByRange(F.col(path)).withColumn("_part", F.spark_partition_id())
    spread = staged(spread, "paths")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(path)) - 1
    return spread.join(sizes, "_part").select((F.col("_base") + rank).cast("long").alias("image_id"), path)


def next_id(images: DataFrame, key: str = "image_id") -> DataFrame:
    """S3: one row, the id after the greatest; 0 for an empty collection."""
    return images.agg((F.coalesce(F.max(key), F.lit(-1)) + 1).cast("long").alias("next_id"))


def open_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The stored table, built and stored first where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        build().write.parquet(path)
    return spark.read.parquet(path)


def missing_features(images: DataFrame, features: DataFrame, key: str = "image_id") -> DataFrame:
    """images that have no features yet."""
    return images.join(features.select(key).distinct(), key, "left_anti")


def vectors_or_empty(images: DataFrame, vectors: DataFrame, value: str, kind: str, key: str = "image_id") -> DataFrame:
    """Each image's stored vector, an empty one where it has none."""
    return images.join(vectors.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.array().cast(kind)))
