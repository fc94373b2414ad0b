"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import staged, uniform

#: log2 of the number of hash buckets, and the n-gram lengths in code points.
BITS = 16
LENGTHS = (1, 2, 3)
#: Most documents of a language that the model is fitted on, on average over hashes of the ids.
PER_LANGUAGE = 2000

#: Code points that are counted or scored at once; longer texts go in pieces that share the n-grams at their borders.
PIECE = 1 << 18

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts after one another, and their n + 1 offsets."""
    low = [t.lower() for t in texts]
    offsets = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=offsets[1:])
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def _pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str], np.ndarray]]:
    """Blocks of about PIECE code points: numbers of texts, lower-cased pieces of them, and how many n-gram starts of a piece are its own."""
    owners: list[int] = []
    parts: list[str] = []
    own: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        low = t.lower()
        for a in range(0, max(1, len(low)), PIECE):
            part = low[a : a + PIECE + max(LENGTHS) - 1]
            owners.append(i)
            parts.append(part)
            own.append(min(PIECE, len(low) - a))
            size += len(part)
            if size >= PIECE:
                yield owners, parts, np.array(own)
                owners, parts, own, size = [], [], [], 0
    if parts:
        yield owners, parts, np.array(own)


def _buckets(codes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram that starts at each position, and bounds of each document's own n-grams."""
    for n in LENGTHS:
        size = max(0, len(codes) - n + 1)
        h = np.zeros(size, np.uint32)
        for k in range(n):
            h ^= codes[k : k + size] * _FACTORS[k]
            h *= np.uint32(0x27D4EB2F)
            h ^= h >> np.uint32(15)
        h += np.uint32(n * 0x165667B1)
        h *= np.uint32(0x9E3779B1)
        yield h >> np.uint32(32 - BITS), np.stack([np.minimum(offsets[:-1], size), np.maximum(np.minimum(offsets[1:] - n + 1, size), np.minimum(offsets[:-1], size))])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): n-gram counts by language, summed in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for lang in sorted(set(langs)):
                own = [texts[i].as_py() or "" for i, x in enumerate(langs) if x == lang]
                sums = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for _, parts, starts in _pieces(own):
                    codes, offsets = _codes(parts)
                    for h, (start, end) in _buckets(codes, offsets):
                        end = np.minimum(end, start + starts)
                        inside = np.zeros(len(h) + 1, np.int32)
                        np.add.at(inside, start, 1)
                        np.add.at(inside, end, -1)
                        sums += np.bincount(h[np.cumsum(inside[:-1]) > 0], minlength=1 << BITS)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at), pa.array(sums[at])], ["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE, seed: str = "language") -> tuple[list[str], np.ndarray]:
    """The languages in code-point order and the (buckets, languages) matrix of log probabilities.

    Learns from rows where ``train`` holds, lang is not null and text is not null: of each language about per_language at
    most, those whose hash of the id is below per_language / rows of that language; rows of one id, or of null ones, are taken together. Languages weigh
    the same a priori.
    """
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    # One row for each language, written so that the planner knows its size: texts move only if it is large.
    sizes = staged(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("rows"))
    picked = rows.join(sizes, "lang").where(uniform(F.lit(seed), F.col("doc_id")) < share)
    found = counts(picked).toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    column = {lang: k for k, lang in enumerate(langs)}
    matrix = np.full((1 << BITS, len(langs)), 0.1, np.float64)
    matrix[found.column("bucket").to_numpy(), [column[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    return langs, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], log_prob: np.ndarray, *keep: str) -> DataFrame:
    """(keep..., lang_pred, score) of every row's whole text.

    score is the posterior of the predicted language where each n-gram counts as 1 / sqrt(n-grams) of one, so that long
    texts don't all score 1. Null texts and texts with no letter are ``und`` with score 0; so is every text if nothing
    could be learned. Ties go to the first language in code-point order. Very long texts are scored in pieces, with the sums of
    the whole; equal rows score alike; an empty table gives no rows. Columns besides text and keep are ignored; those of keep must
    not bear the names of the result's own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(log_prob)
    slim = docs.select(*keep, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            known = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(langs)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if langs and texts:
                sums, grams = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
                for owners, parts, starts in _pieces(texts):
                    codes, offsets = _codes(parts)
                    for h, (start, end) in _buckets(codes, offsets):
                        end = np.minimum(end, start + starts)
                        total = np.zeros((len(h) + 1, len(langs)))
                        np.cumsum(matrix[h], axis=0, dtype=np.float64, out=total[1:])
                        np.add.at(sums, owners, total[end] - total[start])
                        np.add.at(grams, owners, end - start)
                logits = sums / np.sqrt(np.maximum(grams, 1))[:, None]
                odds = np.exp(logits - logits.max(axis=1, keepdims=True))
                best, score = sums.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
            names = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], [*keep, "lang_pred", "score"])

    return slim.mapInArrow(run, f"{types}, lang_pred string, score double")
