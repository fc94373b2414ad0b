"""Operator 9: quality classifier by supervised subword embeddings.

Hashed words, word pairs and character n-grams have learned vectors; a document is the average of its features' vectors
and a softmax layer gives its class. Training is stochastic gradient descent in numpy on a bounded sample. As the average
and the last layer are linear, the fitted model is kept as one number per bucket: a feature's vector times the layer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glyphlake.llm.common import labelled_sample, span_hashes, sums_by, text_blocks, utf8, word_bounds

#: log2 of the number of hash buckets of each kind of feature; character n-gram lengths in bytes.
BITS = 16
GRAMS = (3, 4, 5)
#: Most rows of a class in the training sample, vector size, passes and first learning rate.
PER_CLASS = 2000
DIM = 8
EPOCHS = 12
RATE = 2.0


class Model(NamedTuple):
    """Log odds of class 1 per bucket (average over a document's features), a bias and the scale of the log odds."""

    weight: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: buckets, and the n + 1 bounds of each document's features among them.

    Words and character n-grams (within the document, white space included, so that word ends show) are hashed as they
    are. A word pair is the difference of its words' hashes, so that a word said twice is one feature whatever the word.
    """
    starts, ends, words = word_bounds(data, offsets)
    hashes = span_hashes(data, starts, ends)
    yield (hashes >> np.uint64(64 - BITS)).astype(np.int64), words
    pair = ((hashes[1:] - hashes[:-1]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    inner = np.ones(len(pair), bool)
    edges = words[1:-1]
    inner[edges[(edges > 0) & (edges < len(hashes))] - 1] = False
    yield pair[inner].astype(np.int64) + (1 << BITS), np.concatenate([[0], np.cumsum(np.maximum(np.diff(words) - 1, 0))])
    for n in GRAMS:
        size = max(0, len(data) - n + 1)
        key = np.full(size, n, np.uint64)
        for k in range(n):
            key = (key << np.uint64(8)) | data[k : k + size]
        inside = np.zeros(size + 1, np.int8)
        lens = np.maximum(np.diff(offsets) - n + 1, 0)
        has = lens > 0
        inside[offsets[:-1][has]] += 1
        inside[(offsets[:-1] + lens)[has]] -= 1
        bucket = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        yield bucket[np.cumsum(inside[:-1], dtype=np.int8) > 0].astype(np.int64) + ((n - 1) << BITS), np.concatenate([[0], np.cumsum(lens)])


BUCKETS = (max(GRAMS)) << BITS


def sparse(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their shares of its features."""
    found = np.concatenate([b for b, _ in features(data, np.array([0, len(data)]))])
    ids, n = np.unique(found, return_counts=True)
    return ids.astype(np.int32), (n / max(1, len(found))).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learn from at most about per_class labelled ids of each class for which ``keep`` holds, one row of each.

    Ids of null, labels other than 0 and 1, and null texts teach nothing. The sample is fitted in one task, whose memory follows from
    per_class: a text has at most BUCKETS features, whatever its length.
    Classes weigh the same in training; the bias then moves the log odds to the classes' shares among all labelled rows.
    Without both classes the score is the share of class 1 (0.5 without any label) for every text.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
    n = {int(r["y"]): int(r["n"]) for r in own.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    prior = float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))
    if len(n) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two growing arrays instead of many small ones: their memory goes back to the system afterwards.
        ids, parts, bounds, ys = np.empty(1 << 20, np.int32), np.empty(1 << 20, np.float32), [0], []
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i in range(batch.num_rows):
                own, share = sparse(data[offsets[i] : offsets[i + 1]])
                end = bounds[-1] + len(own)
                if end > len(ids):
                    ids, parts = (np.concatenate([x, np.empty(max(end, len(x)), x.dtype)]) for x in (ids, parts))
                ids[bounds[-1] : end], parts[bounds[-1] : end] = own, share
                bounds.append(end)
            ys += batch.column("y").to_pylist()
        if ys:
            weight, bias = train([(ids[a:b], parts[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.array(ys))
            yield pa.record_batch([pa.array([weight.astype("<f4").tobytes()]), pa.array([bias])], ["weight", "bias"])

    # The bounded sample meets in one task, in the order of ids, so that reruns agree; the driver gets the fitted numbers alone.
    sample = labelled_sample(docs, labels, label, keep, per_class, "quality").repartition(1).sortWithinPartitions("doc_id", "y")
    fitted = sample.select("text", "y").mapInArrow(run, "weight binary, bias double").collect()
    if not fitted:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    return Model(np.frombuffer(fitted[0]["weight"], "<f4"), fitted[0]["bias"] + prior)


def train(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Log odds per bucket and bias after gradient descent, a document at a time with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    share = np.array([np.mean(ys == 0), np.mean(ys == 1)])
    cost = 0.5 / np.maximum(share, 1e-9)
    target = np.eye(2, dtype=np.float32)
    step, steps = 0, epochs * max(1, len(xs))
    for _ in range(epochs):
        for i in rng.permutation(len(xs)).tolist():
            ids, parts = xs[i]
            lr = np.float32(rate * (1 - step / steps) * cost[ys[i]])
            step += 1
            own = vectors[ids]
            hidden = parts @ own
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            grad = p / p.sum() - target[ys[i]]
            back = layer @ grad
            layer -= lr * np.outer(hidden, grad)
            bias -= lr * np.float32(0.1) * grad
            # A feature's step is not divided by the document's length: shares sum to 1, so long texts would never move it.
            vectors[ids] = own - (lr * np.sqrt(parts))[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: Model, *keep: str, name: str = "score") -> DataFrame:
    """(keep..., score): probability of class 1 of every whole text. Null, empty and blank texts get the bias alone.

    Texts are read whole, whatever their length; equal rows score alike; an empty table gives no rows. Columns besides text and
    keep are ignored; those of keep must not bear the name of the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    schema = StructType([*[slim.schema[c] for c in keep], StructField(name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in text_blocks(batch):
                total, n = np.zeros(j - i), np.zeros(j - i)
                for buckets, bounds in features(data, offsets):
                    total += sums_by(weight[buckets], bounds)
                    n += np.diff(bounds)
                out[i:j] = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(out)], [*keep, name])

    return slim.mapInArrow(run, schema)
