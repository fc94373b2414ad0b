"""Feature extraction (F1-F5) over image files; needs OpenCV, which is optional."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from glyphlake.sources.tables import missing_features

KINDS = ("akaze", "kaze", "sift", "surf")
SCHEMA = "image_id long, kp_id int, x float, y float, vec array<float>"


def _detector(kind: str):
    try:
        import cv2
    except ImportError as e:
        raise RuntimeError("feature extraction needs OpenCV (cv2) on all executors; load stored descriptors instead") from e
    if kind == "surf":
        return cv2.xfeatures2d.SURF_create(400, 4, 2, False, False)
    return {"akaze": cv2.AKAZE_create, "kaze": cv2.KAZE_create, "sift": cv2.SIFT_create}[kind]()


def extract(images: DataFrame, kind: str = "akaze") -> DataFrame:
    """A row per key point of (image_id, content); undecodable and empty images give none."""
    if kind not in KINDS:
        raise ValueError(f"unknown feature {kind!r}; one of {', '.join(KINDS)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = _detector(kind)
        import cv2
        import numpy as np

        for pdf in batches:
            rows = []
            for image_id, content in zip(pdf["image_id"], pdf["content"], strict=True):
                pixels = cv2.imdecode(np.frombuffer(content, np.uint8), cv2.IMREAD_UNCHANGED) if content else None
                if pixels is None:
                    continue
                points, vectors = detector.detectAndCompute(pixels, None)
                rows += [(image_id, k, p.pt[0], p.pt[1], v.astype("float32").tolist()) for k, (p, v) in enumerate(zip(points, vectors if vectors is not None else [], strict=False))]
            yield pd.DataFrame(rows, columns=["image_id", "kp_id", "x", "y", "vec"])

    return images.select("image_id", "content").mapInPandas(run, SCHEMA)


def extract_missing(images: DataFrame, features: DataFrame, kind: str = "akaze") -> DataFrame:
    """features with those of images that had none."""
    return features.unionByName(extract(missing_features(images, features), kind))
