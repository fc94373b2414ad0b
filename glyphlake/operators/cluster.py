"""Flat vocabularies (C1-C3, C8, C11): seeding, assignment, means, Lloyd rounds and the trained codebook.

A codebook has (word_id, centroid). Assignment runs over Arrow batches in numpy against a copy of the codebook where that is
small; a larger one is taken in blocks, each of which improves on the nearest word found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.vectors import sq_l2
from glyphlake.sources.tables import staged

#: Bytes of centroids that are copied to every task at once.
BLOCK_BYTES = 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, dims) of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def codebook_arrays(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Word ids in ascending order and their centroids. Vocabularies are parameters of a model: k rows, whatever the corpus."""
    rows = codebook.select("word_id", "centroid").orderBy("word_id").toArrow()
    return rows.column("word_id").to_numpy().astype(np.int64), _matrix(rows.column("centroid"))


def assign(desc: DataFrame, codebook: DataFrame, vec: str = "vec") -> DataFrame:
    """Desc with the nearest word (lowest id on ties) and its squared distance: word_id, sq."""
    ids, centres = codebook_arrays(codebook)
    if not len(ids):
        raise ValueError("the vocabulary is empty")
    sc, step = desc.sparkSession.sparkContext, max(1, BLOCK_BYTES // (8 * centres.shape[1]))
    out = desc
    for k, a in enumerate(range(0, len(ids), step)):
        out = _nearest(out, sc.broadcast((ids[a : a + step], centres[a : a + step])), vec, first=k == 0)
    return out


def _nearest(desc: DataFrame, shared, vec: str, first: bool) -> DataFrame:
    keep = [c for c in desc.columns if c not in ("word_id", "sq")]
    types = ", ".join(f"`{c}` {desc.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres = shared.value
        for batch in batches:
            x = _matrix(batch.column(vec))
            word, sq = np.empty(len(x), np.int64), np.empty(len(x))
            for i in range(0, len(x), 1024):
                part = x[i : i + 1024]
                # The expanded square finds the candidates; their distances are then taken exactly, so that ties go to the lowest id.
                rough = (centres**2).sum(axis=1)[None] - 2 * part @ centres.T
                near = rough <= rough.min(axis=1, keepdims=True) + 1e-9 * (1 + (part**2).sum(axis=1, keepdims=True))
                for j in range(len(part)):
                    at = np.flatnonzero(near[j])
                    d = ((part[j] - centres[at]) ** 2).sum(axis=1)
                    word[i + j], sq[i + j] = ids[at[d.argmin()]], d.min()
            if not first:
                old_word, old_sq = batch.column("word_id").to_numpy(), batch.column("sq").to_numpy()
                better = sq < old_sq
                word, sq = np.where(better, word, old_word), np.where(better, sq, old_sq)
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(word.astype(np.int32)), pa.array(sq)], [*keep, "word_id", "sq"])

    return desc.mapInArrow(run, f"{types}, word_id int, sq double")


#: Words whose sums a task holds before it passes them on.
HELD = 4096


def means(assigned: DataFrame, word: str = "word_id", vec: str = "vec") -> DataFrame:
    """(word_id, centroid) of the mean vector of each word; empty words have no row.

    Tasks add up vectors in numpy, so that what is shuffled follows the vocabulary and not the descriptors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}

        def passed_on() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["word_id", "n", "total"])
            sums.clear()
            counts.clear()
            return out

        for batch in batches:
            x, w = _matrix(batch.column(vec)), batch.column(word).to_numpy()
            for k in np.unique(w).tolist():
                own = x[w == k]
                sums[k] = sums.get(k, 0) + own.sum(axis=0)
                counts[k] = counts.get(k, 0) + len(own)
            if len(sums) > HELD:
                yield passed_on()
        yield passed_on()

    parts = assigned.select(F.col(word).cast("int").alias(word), vec).mapInArrow(run, "word_id int, n long, total array<double>")
    by_dim = parts.select("word_id", "n", F.posexplode("total").alias("dim", "x")).groupBy("word_id", "dim").agg((F.sum("x") / F.sum("n")).alias("x"))
    packed = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return by_dim.groupBy("word_id").agg(F.transform(packed, lambda p: p["x"]).alias("centroid"))


def lloyd_step(desc: DataFrame, codebook: DataFrame, vec: str = "vec") -> DataFrame:
    """The codebook after one round; a word without descriptors keeps its centroid."""
    fresh = means(assign(desc, codebook, vec), vec=vec)
    return codebook.join(fresh.withColumnRenamed("centroid", "fresh"), "word_id", "left").select("word_id", F.coalesce("fresh", "centroid").alias("centroid"))


def inertia(assigned: DataFrame) -> DataFrame:
    """Sum of the squared distances to the assigned words, one row."""
    return assigned.agg(F.sum("sq").alias("inertia"))


def nearest_seed(desc: DataFrame, seeds: list[list[float]], vec: str = "vec") -> DataFrame:
    """Desc with min_sq, the squared distance to the nearest of the given seeds."""
    return desc.withColumn("min_sq", F.least(*[sq_l2(F.col(vec), F.array(*[F.lit(float(x)) for x in s])) for s in seeds]) if len(seeds) > 1 else sq_l2(F.col(vec), F.array(*[F.lit(float(x)) for x in seeds[0]])))


def seed_plus_plus(desc: DataFrame, k: int, seed: int = 0, key: str = "vec_id", vec: str = "vec") -> DataFrame:
    """K descriptors, the first by a hash of its id, each next with probability in proportion to min_sq.

    A draw by weight is the greatest of u ** (1 / w) over hashes u of the ids, so it is one distributed maximum per
    seed and needs no running sum over all rows. Stops early where every descriptor coincides with a seed.
    """
    order = lambda turn: (F.xxhash64(F.lit(seed), F.lit(turn), F.col(key)).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    first = desc.select(key, vec).orderBy(order(0), key).limit(1).collect()
    if not first:
        raise ValueError("no descriptors to seed from")
    chosen = [list(map(float, first[0][vec]))]
    state = staged(nearest_seed(desc.select(key, vec), chosen, vec), "seeds")
    while len(chosen) < k:
        drawn = state.where("min_sq > 0").select(vec, (F.log(order(len(chosen))) / F.col("min_sq")).alias("rank"), key).orderBy(F.desc("rank"), key).limit(1).collect()
        if not drawn:
            break
        chosen.append(list(map(float, drawn[0][vec])))
        newest = F.array(*[F.lit(x) for x in chosen[-1]])
        state = state.withColumn("min_sq", F.least("min_sq", sq_l2(F.col(vec), newest)))
        if len(chosen) % 8 == 0:
            state = staged(state, "seeds")
    return desc.sparkSession.createDataFrame([(i, c) for i, c in enumerate(chosen)], "word_id int, centroid array<double>")


def train_codebook(desc: DataFrame, k: int, max_iter: int = 16, tol: float = 1e-4, seed: int = 0, key: str = "vec_id", vec: str = "vec") -> DataFrame:
    """A flat codebook of at most k words: seeding, then rounds until no centroid moves more than tol or max_iter is reached.

    k is capped at the number of descriptors. The centroids are k vectors on the driver between rounds; rows never are.
    """
    n = desc.count()
    if not n:
        raise ValueError("no descriptors to train on")
    spark = desc.sparkSession
    desc = staged(desc.select(key, vec), "train")
    codebook = seed_plus_plus(desc, min(k, n), seed, key, vec)
    for _ in range(max_iter):
        ids, old = codebook_arrays(codebook)
        fresh = {r["word_id"]: r["centroid"] for r in means(assign(desc, codebook, vec), vec=vec).collect()}
        new = np.array([fresh.get(int(i), old[j]) for j, i in enumerate(ids)], np.float64)
        codebook = spark.createDataFrame([(int(i), [float(x) for x in c]) for i, c in zip(ids, new, strict=True)], "word_id int, centroid array<double>")
        if ((new - old) ** 2).sum(axis=1).max(initial=0) <= tol * tol:
            break
    return codebook


def feature_cap(images: DataFrame, n: str, most: int, key: str = "image_id") -> DataFrame:
    """Images in order of key up to and with the one at which the running count of descriptors reaches ``most``.

    Counts are summed by blocks of keys first, so the running sum is over blocks and then within the block that crosses.
    """
    blocks = images.withColumn("_block", F.floor(F.col(key) / 1024)).groupBy("_block").agg(F.sum(n).alias("_n"))
    upto = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = images.withColumn("_block", F.floor(F.col(key) / 1024)).join(blocks, "_block")
    before = F.col("_before") + F.coalesce(F.sum(n).over(inner), F.lit(0))
    return rows.withColumn("_sum", before).where(F.col("_sum") < most).drop("_block", "_before", "_sum")


def sample(images: DataFrame, count: int, seed: int = 0, key: str = "image_id") -> DataFrame:
    """C11: count images by a hash of the seed and the id; all of them where there are fewer."""
    return images.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(count)
