"""Vocabulary trees (C1-C7, C9, C10, A1, A8): hierarchical k-means a level at a time, descent, words, weights and node vectors.

A tree is a table (node_id, parent_id, level, centroid, weight, word_id); the root has node 0 and no parent. All nodes of a
level are trained in the same jobs, keyed by node, so jobs grow with the depth and not with the number of nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.operators.bow import word_weights
from glyphlake.operators.cluster import _matrix
from glyphlake.sources.tables import staged, unstage

SCHEMA = "node_id int, parent_id int, level int, centroid array<double>, weight double, word_id int"


def _step(desc: DataFrame, children: dict[int, tuple[np.ndarray, np.ndarray]], metric: str) -> DataFrame:
    """desc with node_id moved to its best child and ``sq`` to it; rows at nodes without children stay as they are."""
    keep = [c for c in desc.columns if c not in ("node_id", "sq")]
    types = ", ".join(f"`{c}` {desc.schema[c].dataType.simpleString()}" for c in keep)
    shared = desc.sparkSession.sparkContext.broadcast(children)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, node = _matrix(batch.column("vec")), batch.column("node_id").to_numpy().copy()
            sq = np.zeros(len(node))
            for parent in np.unique(node).tolist():
                if parent in shared.value:
                    ids, centres = shared.value[parent]
                    at = np.flatnonzero(batch.column("node_id").to_numpy() == parent)
                    d = np.stack([((x[at] - c) ** 2).sum(axis=1) if metric == "l2" else -(x[at] @ c) for c in centres], axis=1)
                    node[at], sq[at] = ids[d.argmin(axis=1)], d.min(axis=1)
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(node.astype(np.int32)), pa.array(sq)], [*keep, "node_id", "sq"])

    return desc.mapInArrow(run, f"{types}, node_id int, sq double")


def _seed(state: DataFrame, nodes: list[int], split: int, seed: int) -> dict[int, list[np.ndarray]]:
    """C1 for all nodes at once: per seed one job that takes each node's greatest log(u) / min_sq, min_sq to its seeds so far."""
    u = lambda turn: (F.xxhash64(F.lit(seed), F.lit(turn), "vec_id").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    rows = state.where(F.col("node_id").isin(nodes)).withColumn("own", F.col("node_id"))
    first = rows.groupBy("own").agg(F.max_by("vec", F.struct(u(0).alias("u"), "vec_id")).alias("vec")).collect()
    seeds = {r["own"]: [np.array(r["vec"])] for r in first}
    todo = set(seeds)
    for turn in range(1, split):
        far = _step(rows.where(F.col("node_id").isin(sorted(todo))), {k: (np.arange(len(seeds[k])), np.stack(seeds[k])) for k in todo}, "l2").where("sq > 0")
        drawn = far.groupBy("own").agg(F.max_by("vec", F.struct((F.log(u(turn)) / F.col("sq")).alias("r"), "vec_id")).alias("vec")).collect()
        todo = {r["own"] for r in drawn}
        if not todo:
            break
        for r in drawn:
            seeds[r["own"]].append(np.array(r["vec"]))
    return seeds


def _sums(assigned: DataFrame) -> dict[int, tuple[int, int, np.ndarray]]:
    """Of each node its descriptors, a mark of which they are, and the mean vector: one pass, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            x, node = _matrix(batch.column("vec")), batch.column("node_id").to_numpy()
            mark = (batch.column("vec_id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
            for k in np.unique(node).tolist():
                own = node == k
                held = total.setdefault(k, [0, 0, 0.0])
                held[0] += int(own.sum())
                held[1] = (held[1] + int(mark[own].sum())) % (1 << 40)
                held[2] = held[2] + x[own].sum(axis=0)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([v[2].tolist() for v in total.values()], pa.list_(pa.float64()))], ["node_id", "n", "mark", "total"])

    parts = assigned.select("vec_id", "node_id", "vec").mapInArrow(run, "node_id int, n long, mark long, total array<double>")
    by_dim = parts.select("node_id", "n", "mark", F.posexplode("total").alias("dim", "x")).groupBy("node_id", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), (F.sum("mark") % (1 << 40)).alias("mark"))
    rows = by_dim.groupBy("node_id").agg(F.first("n").alias("n"), F.first("mark").alias("mark"), F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).collect()
    return {r["node_id"]: (r["n"], r["mark"], np.array([p["x"] for p in r["v"]]) / r["n"]) for r in rows}


def train_tree(desc: DataFrame, depth: int = 4, split: int = 6, seed: int = 0, max_iter: int | None = None, weighting: str = "tf_idf", unit: bool = False) -> DataFrame:
    """The tree of (vec_id, image_id, vec).

    A node with at most ``split`` descriptors gets a child for each, without further rounds; a child with one descriptor or
    none is a leaf. Rounds end when no descriptor changes its child, or after max_iter if that is given; an empty child keeps its
    centroid. Descriptors stay as they are in all rounds of a level: each round sends the children out and brings sums back. unit: centroids are scaled to length 1 and children chosen by inner product, as the first generation does.
    The tree (at most split ** depth centroids) is on the driver; descriptors never are.
    """
    metric = "dot" if unit else "l2"
    state = staged(desc.select("vec_id", "image_id", F.col("vec").cast("array<double>").alias("vec"), F.lit(0).alias("node_id")), "tree")
    if state.isEmpty():
        raise ValueError("no descriptors to train on")
    nodes: list[tuple] = [(0, None, 0, None)]
    spent = [state]
    for level in range(1, depth + 1):
        sizes = {r["node_id"]: r["n"] for r in state.groupBy("node_id").agg(F.count("*").alias("n")).collect()}
        open_nodes = sorted(k for k, n in sizes.items() if n > 1 or level == 1)
        if not open_nodes:
            break
        state = state.where(F.col("node_id").isin(open_nodes))
        small = [k for k in open_nodes if sizes[k] <= split]
        big = [k for k in open_nodes if sizes[k] > split]
        centres: dict[int, list[np.ndarray]] = {}
        if small:
            for r in state.where(F.col("node_id").isin(small)).orderBy("node_id", "vec_id").collect():
                centres.setdefault(r["node_id"], []).append(np.array(r["vec"]))
        if big:
            centres |= _seed(state, big, split, seed + level)
        children, at = {}, len(nodes)
        for parent in sorted(centres):
            own = np.stack(centres[parent])
            children[parent] = (np.arange(at, at + len(own)), _unit(own) if unit else own)
            at += len(own)
        before, rounds = None, 0
        while big and (max_iter is None or rounds < max_iter):
            found, rounds = _sums(_step(state, children, metric)), rounds + 1
            marks = {k: v[:2] for k, v in found.items()}
            if marks == before:
                break
            before = marks
            for parent in big:
                ids, old = children[parent]
                new = np.stack([found[int(i)][2] if int(i) in found else old[j] for j, i in enumerate(ids)])
                children[parent] = (ids, _unit(new) if unit else new)
        state = staged(_step(state, children, metric).select("vec_id", "image_id", "vec", "node_id"), "tree")
        spent.append(state)
        for parent in sorted(children):
            nodes += [(int(i), parent, level, [float(x) for x in c]) for i, c in zip(*children[parent], strict=True)]
    unstage(*spent)
    table = desc.sparkSession.createDataFrame([(*n, None, None) for n in nodes], SCHEMA)
    return weigh(create_words(table), desc, weighting, metric)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def create_words(nodes: DataFrame) -> DataFrame:
    """Leaves get words 0.. in node order; inner nodes none. A tree has few rows, so one window numbers them."""
    parents = nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    leaves = nodes.join(parents, "node_id", "left_anti").where("parent_id is not null")
    words = leaves.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).cast("int").alias("word_id"))
    return nodes.drop("word_id").join(words, "node_id", "left")


def weigh(nodes: DataFrame, desc: DataFrame, weighting: str = "tf_idf", metric: str = "l2") -> DataFrame:
    """Nodes with the weight of each word; words that no image has weigh 0."""
    seen = descend(desc, nodes, metric).select("image_id", "word_id")
    weights = word_weights(seen, weighting)
    return nodes.drop("weight").join(weights, "word_id", "left").select("node_id", "parent_id", "level", "centroid", F.when(F.col("word_id").isNotNull(), F.coalesce("weight", F.lit(0.0))).alias("weight"), "word_id")


def descend(desc: DataFrame, nodes: DataFrame, metric: str = "l2", levels_up: int = 0) -> DataFrame:
    """A1: desc with node_id, word_id and weight of the leaf that greedy steps lead to (lowest node on ties).

    levels_up > 0 adds ``ancestor``, the node that many levels above the leaf (the root where there are fewer).
    """
    rows = nodes.select("node_id", "parent_id", "centroid", "word_id", "weight").orderBy("node_id").collect()
    children: dict[int, tuple[list, list]] = {}
    for r in rows:
        if r["parent_id"] is not None:
            ids, centres = children.setdefault(r["parent_id"], ([], []))
            ids.append(r["node_id"])
            centres.append(r["centroid"])
    if not children:
        raise ValueError("the vocabulary is empty")
    arrays = {k: (np.array(i), np.array(c, np.float64)) for k, (i, c) in children.items()}
    parent = {r["node_id"]: r["parent_id"] for r in rows}
    level: dict[int, int] = {}
    for r in rows:
        level[r["node_id"]] = 0 if r["parent_id"] is None else level[r["parent_id"]] + 1
    out = desc.drop("word_id", "weight", "sq").withColumn("node_id", F.lit(0))
    for _ in range(max(level.values())):
        out = _step(out, arrays, metric)
    leaves = nodes.where("word_id is not null").select("node_id", "word_id", "weight")
    if levels_up > 0:
        up = []
        for r in rows:
            node = r["node_id"]
            for _ in range(levels_up):
                node = parent[node] if parent[node] is not None else node
            up.append((r["node_id"], node))
        leaves = leaves.join(desc.sparkSession.createDataFrame(up, "node_id int, ancestor int"), "node_id")
    return out.drop("sq").join(F.broadcast(leaves), "node_id")


def ancestors(nodes: DataFrame, depth: int) -> DataFrame:
    """(leaf, node_id): every node on the way from the root to each node, itself included."""
    paths = nodes.select(F.col("node_id").alias("leaf"), "node_id")
    out, up = paths, nodes.where("parent_id is not null").select("node_id", "parent_id")
    for _ in range(depth):
        paths = paths.join(up, "node_id").select("leaf", F.col("parent_id").alias("node_id"))
        out = out.unionByName(paths)
    return out


def node_counts(leaves: DataFrame, paths: DataFrame, image: str = "image_id") -> DataFrame:
    """(image, node_id, n): descriptors of an image below every node of the tree, from (image, leaf) rows.

    Descriptors are counted by leaf before the counts go up the paths.
    """
    by_leaf = leaves.groupBy(image, "leaf").agg(F.count("*").alias("n"))
    return by_leaf.join(paths, "leaf").groupBy(image, "node_id").agg(F.sum("n").alias("n"))


def node_vectors(counts: DataFrame, weights: DataFrame | None = None, image: str = "image_id") -> DataFrame:
    """(image, node_id, value): counts times weights, scaled to length 1; a vector of length 0 stays zero."""
    value = F.col("n").cast("double")
    if weights is not None:
        counts, value = counts.join(weights.select("node_id", "weight"), "node_id"), value * F.col("weight")
    raw = counts.select(image, "node_id", value.alias("value"))
    size = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy(image)))
    return raw.withColumn("_s", size).select(image, "node_id", F.when(F.col("_s") > 0, F.col("value") / F.col("_s")).otherwise(F.lit(0.0)).alias("value"))
