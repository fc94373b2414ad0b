"""Pixel tables (image_id, y, x, v): integral images, Hough lines and grayscale."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.scalars import LUMA, gray


def pixels_of(df: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """(image_id, y, x, v) of rows whose vector is an image, row by row."""
    return df.select(F.col(key).alias("image_id"), F.posexplode(vec).alias("_i", "v")).select("image_id", F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"), "v")


def integral_image(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, s): sums of all pixels above and left of each corner, with a row and a column of zeros in front."""
    along = Window.partitionBy("image_id", "y").orderBy("x")
    down = Window.partitionBy("image_id", "x").orderBy("y")
    rows = pixels.withColumn("_r", F.sum("v").over(along)).select("image_id", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), F.sum("_r").over(down).alias("s"))
    zero = F.lit(0).cast(dict(rows.dtypes)["s"]).alias("s")
    # Zeros along both edges, each once: the corner comes with the columns.
    left = pixels.select("image_id", (F.col("y") + 1).alias("y"), F.lit(0).alias("x"), zero).distinct()
    top = pixels.select("image_id", F.lit(0).alias("y"), (F.col("x") + 1).alias("x"), zero).distinct()
    corner = pixels.select("image_id", F.lit(0).alias("y"), F.lit(0).alias("x"), zero).distinct()
    return rows.unionByName(left).unionByName(top).unionByName(corner)


def hough_votes(pixels: DataFrame, rho: float, theta: float) -> DataFrame:
    """(image_id, rho_bin, theta_bin, votes): every non-zero pixel votes once for each angle step in [0, pi)."""
    steps = max(1, round(math.pi / theta))
    angles = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("theta_bin")
    votes = pixels.where("v <> 0").select("image_id", "x", "y", angles)
    angle = F.col("theta_bin") * F.lit(float(theta))
    distance = (F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle)) / F.lit(float(rho))
    return votes.withColumn("rho_bin", F.floor(distance + 0.5).cast("int")).groupBy("image_id", "rho_bin", "theta_bin").agg(F.count("*").alias("votes"))


def hough_lines(pixels: DataFrame, rho: float = 2.0, theta: float = 2.0, threshold: int = 2) -> DataFrame:
    """(image_id, rho, theta, votes) of bins above the threshold that beat their neighbours, most votes first by rank."""
    votes = hough_votes(pixels, rho, theta)

    def beside(column: str, other: str) -> tuple:
        order = Window.partitionBy("image_id", other).orderBy(column).rangeBetween(-1, -1), Window.partitionBy("image_id", other).orderBy(column).rangeBetween(1, 1)
        return tuple(F.coalesce(F.sum("votes").over(w), F.lit(0)) for w in order)

    before_r, after_r = beside("rho_bin", "theta_bin")
    before_t, after_t = beside("theta_bin", "rho_bin")
    peak = votes.withColumn("_br", before_r).withColumn("_ar", after_r).withColumn("_bt", before_t).withColumn("_at", after_t)
    peak = peak.where((F.col("votes") > threshold) & (F.col("votes") > F.col("_br")) & (F.col("votes") >= F.col("_ar")) & (F.col("votes") > F.col("_bt")) & (F.col("votes") >= F.col("_at")))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("votes"), "rho_bin", "theta_bin"))
    return peak.select("image_id", (F.col("rho_bin") * F.lit(float(rho))).alias("rho"), (F.col("theta_bin") * F.lit(float(theta))).alias("theta"), "votes", rank.alias("rank"))


def to_gray(pixels: DataFrame, weights: tuple[float, float, float] = LUMA) -> DataFrame:
    """(image_id, y, x, v) from channel columns c0, c1, c2 (0..255)."""
    return pixels.select("image_id", "y", "x", gray(F.col("c0"), F.col("c1"), F.col("c2"), weights).alias("v"))


def to_rgb(pixels: DataFrame) -> DataFrame:
    """A single channel repeated to three."""
    return pixels.select("image_id", "y", "x", F.col("v").alias("c0"), F.col("v").alias("c1"), F.col("v").alias("c2"))
