"""Geometric verification (G1-G5): ratio matching by joins, RANSAC per image pair, and the verdict on the first results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.vectors import sq_l2

#: A match is kept below this share of the second distance; inliers lie within so many pixels; at least so many matches
#: are needed; a verdict needs so many inliers and more than so much confidence.
RATIO, PIXELS, LEAST_MATCHES, LEAST_INLIERS, LEAST_CONFIDENCE = 0.8, 3.0, 9, 16, 0.7
#: Most trials, and the probability that one of them had inliers alone, at which they end.
TRIALS, SURE = 500, 0.99
PAIR = "query_id long, image_id long"


def _one_way(distances: DataFrame, own: str, other: str) -> DataFrame:
    order = Window.partitionBy("query_id", "image_id", own).orderBy("sq", other)
    ranked = distances.withColumn("_n", F.row_number().over(order)).withColumn("_second", F.lead("sq").over(order))
    return ranked.where((F.col("_n") == 1) & (F.col("sq") < RATIO * RATIO * F.col("_second"))).select("query_id", "image_id", "kp_q", "kp_t")


def ratio_matches(pairs: DataFrame, desc: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """G1: (query_id, image_id, kp_q, kp_t) of the pairs of images, exact nearest neighbours.

    A descriptor matches its nearest one of the other image if that is nearer than RATIO of the second; matches of both
    directions are united. With a single descriptor on the other side there is no second, so none. asked: descriptors of the
    queries, where they are not those of desc.
    """
    q = (desc if asked is None else asked).select(F.col("image_id").alias("query_id"), F.col("kp_id").alias("kp_q"), F.col("vec").alias("vec_q"))
    t = desc.select("image_id", F.col("kp_id").alias("kp_t"), F.col("vec").alias("vec_t"))
    both = pairs.select("query_id", "image_id").join(q, "query_id").join(t, "image_id")
    distances = both.select("query_id", "image_id", "kp_q", "kp_t", sq_l2(F.col("vec_q"), F.col("vec_t")).alias("sq"))
    return _one_way(distances, "kp_q", "kp_t").unionByName(_one_way(distances, "kp_t", "kp_q")).distinct()


def confidence(inliers: Column, matches: Column) -> Column:
    return inliers / (8.0 + 0.3 * matches)


def is_good(inliers: Column, conf: Column) -> Column:
    """Enough inliers and confidence."""
    return (inliers >= LEAST_INLIERS) & (conf > LEAST_CONFIDENCE)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = x.mean(axis=0)
    spread = np.sqrt(((x - centre) ** 2).sum(axis=1)).mean()
    s = np.sqrt(2) / spread if spread > 0 else 1.0
    return (x - centre) * s, np.array([[s, 0, -s * centre[0]], [0, s, -s * centre[1]], [0, 0, 1]])


def fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fundamental matrix of eight or more correspondences: normalised linear solution of rank two."""
    (x, tx), (y, ty) = _scaled(a), _scaled(b)
    rows = np.column_stack([y[:, 0] * x[:, 0], y[:, 0] * x[:, 1], y[:, 0], y[:, 1] * x[:, 0], y[:, 1] * x[:, 1], y[:, 1], x[:, 0], x[:, 1], np.ones(len(x))])
    f = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    u, s, v = np.linalg.svd(f)
    f = ty.T @ (u * [s[0], s[1], 0]) @ v @ tx
    return f / max(np.abs(f).max(), 1e-300)


def epipolar_distance(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The greater distance of either point to the other's epipolar line."""
    one = np.ones((len(a), 1))
    p, q = np.hstack([a, one]), np.hstack([b, one])
    lp, lq = p @ f.T, q @ f
    e = np.abs((q * lp).sum(axis=1))
    return np.maximum(e / np.maximum(np.hypot(lp[:, 0], lp[:, 1]), 1e-12), e / np.maximum(np.hypot(lq[:, 0], lq[:, 1]), 1e-12))


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The homography of four or more correspondences, by the normalised direct linear transform."""
    (x, tx), (y, ty) = _scaled(a), _scaled(b)
    one, zero = np.ones((len(x), 1)), np.zeros((len(x), 3))
    p = np.hstack([x, one])
    rows = np.vstack([np.hstack([zero, -p, y[:, 1:] * p]), np.hstack([p, zero, -y[:, :1] * p])])
    h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    h = np.linalg.inv(ty) @ h @ tx
    return h / (h[2, 2] if abs(h[2, 2]) > 1e-12 else 1.0)


def transfer_distance(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p = np.hstack([a, np.ones((len(a), 1))]) @ h.T
    w = np.where(np.abs(p[:, 2:]) < 1e-12, 1e-12, p[:, 2:])
    return np.sqrt(((p[:, :2] / w - b) ** 2).sum(axis=1))


MODELS = {"f": (8, fundamental, epipolar_distance), "h": (4, homography, transfer_distance)}


def ransac(a: np.ndarray, b: np.ndarray, model: str = "f", seed: int = 0, trials: int = TRIALS, pixels: float = PIXELS) -> tuple[np.ndarray | None, np.ndarray]:
    """The model with most inliers and their mask; fewer matches than LEAST_MATCHES have no model.

    Trials end once the best model's share of inliers says that with probability SURE one trial had only inliers.
    """
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; f or h")
    if len(a) < LEAST_MATCHES:
        return None, np.zeros(len(a), bool)
    size, solve, distance = MODELS[model]
    rng, best, mask = np.random.default_rng(seed), None, np.zeros(len(a), bool)
    done, enough = 0, trials
    while done < enough:
        done += 1
        at = rng.choice(len(a), size, replace=False)
        try:
            m = solve(a[at], b[at])
        except np.linalg.LinAlgError:
            continue
        near = distance(m, a, b) <= pixels
        if near.sum() > mask.sum():
            best, mask = m, near
            chance = near.mean() ** size
            enough = min(trials, int(np.ceil(np.log(1 - SURE) / np.log(1 - chance)))) if chance < 1 else 0
    if best is not None and mask.sum() >= size:
        refined = solve(a[mask], b[mask])
        near = distance(refined, a, b) <= pixels
        if near.sum() >= mask.sum():
            best, mask = refined, near
    if model == "h" and best is not None and abs(np.linalg.det(best)) < 1e-9:
        return None, np.zeros(len(a), bool)
    return best, mask


def verify(matches: DataFrame, keypoints: DataFrame, model: str = "f", seed: int = 0, asked: DataFrame | None = None) -> DataFrame:
    """(query_id, image_id, n_matches, num_inliers, confidence, good) of point matches (query_id, image_id, kp_q, kp_t).

    keypoints: (image_id, kp_id, x, y). Each pair of images is one group of at most its matches; draws depend on the seed
    and the pair alone. Pairs with fewer than nine matches have no inliers and confidence 0. asked: key points of the
    queries, where they are not those of keypoints.
    """
    q = (keypoints if asked is None else asked).select(F.col("image_id").alias("query_id"), F.col("kp_id").alias("kp_q"), F.col("x").alias("xq"), F.col("y").alias("yq"))
    t = keypoints.select("image_id", F.col("kp_id").alias("kp_t"), F.col("x").alias("xt"), F.col("y").alias("yt"))
    points = matches.join(q, ["query_id", "kp_q"]).join(t, ["image_id", "kp_t"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["kp_q", "kp_t"])
        a, b = pdf[["xq", "yq"]].to_numpy(float), pdf[["xt", "yt"]].to_numpy(float)
        query, image = int(pdf["query_id"].iloc[0]), int(pdf["image_id"].iloc[0])
        _, mask = ransac(a, b, model, seed ^ (hash((query, image)) & 0x7FFFFFFF))
        n = int(mask.sum())
        return pd.DataFrame({"query_id": [query], "image_id": [image], "n_matches": [len(a)], "num_inliers": [n], "confidence": [n / (8.0 + 0.3 * len(a)) if len(a) >= LEAST_MATCHES else 0.0]})

    found = points.groupBy("query_id", "image_id").applyInPandas(run, f"{PAIR}, n_matches int, num_inliers int, confidence double")
    return found.withColumn("good", is_good(F.col("num_inliers"), F.col("confidence")))


def validate_top(ranked: DataFrame, verdicts: DataFrame, top: int = 10) -> DataFrame:
    """Ranked results with mark: 1 where one of the first ``top`` is verified, -1 where it is not, 0 beyond."""
    both = ranked.join(verdicts.select("query_id", "image_id", "good"), ["query_id", "image_id"], "left")
    return both.withColumn("mark", F.when(F.col("rank") > top, 0).when(F.coalesce("good", F.lit(False)), 1).otherwise(-1)).drop("good")
