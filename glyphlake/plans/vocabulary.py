"""Queries on vectors, codebooks, bags of words and trees, over ``embeddings`` as local descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions import vectors
from glyphlake.operators import bow, cluster, tree
from glyphlake.sources.tables import descriptors, read, staged

#: DuckDB: descriptors, exploded; the codebook of mean vectors per label; nearest words; histograms; weights; tf-idf vectors.
DESC = """d AS (SELECT vec_id, vec_id // 5 AS image_id, CAST(vec_id % 5 AS INTEGER) AS kp_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
e AS (SELECT vec_id, image_id, kp_id, label, unnest(vec) AS x, CAST(unnest(range(len(vec))) AS INTEGER) AS dim FROM d)"""
ASSIGNED = DESC + """,
c AS (SELECT label AS word_id, dim, avg(x) AS x FROM e GROUP BY ALL),
dist AS (SELECT e.vec_id, e.image_id, e.kp_id, c.word_id, sum((e.x - c.x) * (e.x - c.x)) AS sq FROM e JOIN c USING (dim) GROUP BY ALL),
a AS (SELECT vec_id, image_id, kp_id, word_id, sq FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sq, word_id) AS rn FROM dist) WHERE rn = 1)"""
BOW = ASSIGNED + """,
h AS (SELECT image_id, word_id, count(*) AS n FROM a GROUP BY ALL),
w AS (SELECT word_id, ln((SELECT count(DISTINCT image_id) FROM h) * 1.0 / count(DISTINCT image_id)) AS weight FROM h GROUP BY word_id),
b0 AS (SELECT image_id, word_id, h.n * w.weight AS value FROM h JOIN w USING (word_id) WHERE weight > 0),
b AS (SELECT image_id, word_id, value / sum(value) OVER (PARTITION BY image_id) AS value FROM b0)"""
TOKENS = """t AS (SELECT doc_id AS image_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY ALL),
tw AS (SELECT word, ln((SELECT count(DISTINCT image_id) FROM t) * 1.0 / count(DISTINCT image_id)) AS weight FROM t GROUP BY word)"""
TREE = DESC + """,
c1 AS (SELECT 1 + label AS node_id, dim, avg(x) AS x FROM e GROUP BY ALL),
c2 AS (SELECT 1 + label AS parent_id, 100 + 2 * label + vec_id % 2 AS node_id, dim, avg(x) AS x FROM e GROUP BY ALL),
s1 AS (SELECT vec_id, image_id, node_id FROM (SELECT e.vec_id, e.image_id, c1.node_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY sum((e.x - c1.x) * (e.x - c1.x)), c1.node_id) AS rn FROM e JOIN c1 USING (dim) GROUP BY e.vec_id, e.image_id, c1.node_id) WHERE rn = 1),
s2 AS (SELECT vec_id, image_id, top, node_id FROM (SELECT e.vec_id, e.image_id, s1.node_id AS top, c2.node_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY sum((e.x - c2.x) * (e.x - c2.x)), c2.node_id) AS rn FROM e JOIN s1 USING (vec_id) JOIN c2 ON c2.parent_id = s1.node_id AND c2.dim = e.dim GROUP BY e.vec_id, e.image_id, s1.node_id, c2.node_id) WHERE rn = 1),
nodes AS (SELECT image_id, 0 AS node_id FROM s2 UNION ALL SELECT image_id, top FROM s2 UNION ALL SELECT image_id, node_id FROM s2),
nc AS (SELECT image_id, CAST(node_id AS INTEGER) AS node_id, count(*) AS n FROM nodes GROUP BY ALL),
nw AS (SELECT node_id, ln((SELECT count(DISTINCT image_id) FROM nc) * 1.0 / count(*)) AS weight FROM nc GROUP BY node_id)"""


def desc_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descriptors(read(spark, sf_dir, "embeddings"))


def label_codebook(desc: DataFrame) -> DataFrame:
    """A deterministic vocabulary: the mean vector of each label."""
    return cluster.means(desc, "label")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = desc_of(spark, sf_dir)
    return cluster.assign(desc, label_codebook(desc))


def image_bow(spark: SparkSession, sf_dir: str, weighting: str = "tf_idf") -> DataFrame:
    words = staged(bow.histogram(assigned(spark, sf_dir)), "histogram")
    return bow.normalize(bow.transform(words, bow.word_weights(words, weighting), weighting))


def pairs(spark: SparkSession, sf_dir: str, column) -> DataFrame:
    desc = desc_of(spark, sf_dir).select("image_id", "vec_id", "vec")
    a, b = desc.alias("a"), desc.alias("b")
    both = a.join(b, F.col("a.image_id") == F.col("b.image_id")).where("a.vec_id < b.vec_id")
    return both.select(F.col("a.vec_id").alias("vec_a"), F.col("b.vec_id").alias("vec_b"), F.round(column(F.col("a.vec"), F.col("b.vec")), 6).alias("value"))


def sq_l2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, vectors.sq_l2)


def dot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir, vectors.dot)


def _pair_sql(term: str) -> str:
    return f"""WITH {DESC} SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(sum({term}), 6) AS value
FROM e a JOIN e b ON a.image_id = b.image_id AND a.dim = b.dim AND a.vec_id < b.vec_id GROUP BY ALL"""


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = desc_of(spark, sf_dir)
    scaled = desc.withColumn("vec", F.transform("vec", lambda x: x * (F.col("vec_id") + 1)))
    rows = vectors.l2_normalize(scaled).select("vec_id", F.posexplode("vec").alias("dim", "x"))
    return rows.select("vec_id", "dim", F.round("x", 6).alias("x"))


def dense_to_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = desc_of(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: F.floor(x * 10) / 10))
    return vectors.dense_to_sparse(coarse, "vec", "vec_id").select("vec_id", "idx", F.round("value", 6).alias("value"))


def flatten_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = vectors.flatten_rows(desc_of(spark, sf_dir), "image_id", "kp_id")
    return flat.select("image_id", F.posexplode("flat").alias("pos", "x")).select("image_id", "pos", F.round("x", 6).alias("x"))


def reshape_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.explode_rows(desc_of(spark, sf_dir).withColumn("m", vectors.reshape(F.col("vec"), 8)), "m", "vec_id")
    return rows.select("vec_id", "row_id", F.round(vectors.total(F.col("row")), 6).alias("row_sum"))


def concat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = desc_of(spark, sf_dir)
    parts = [desc.where(F.col("label") % 2 == k).select("vec_id", "vec") for k in (0, 1)]
    return vectors.concat_rows(*parts).select("part", "vec_id", F.round(vectors.total(F.col("vec")), 6).alias("row_sum"))


def cluster_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_codebook(desc_of(spark, sf_dir)).select("word_id", F.posexplode("centroid").alias("dim", "x")).select("word_id", "dim", F.round("x", 6).alias("x"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("vec_id", "word_id", F.round("sq", 6).alias("sq"))


def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = desc_of(spark, sf_dir)
    return cluster.lloyd_step(desc, label_codebook(desc)).select("word_id", F.posexplode("centroid").alias("dim", "x")).select("word_id", "dim", F.round("x", 6).alias("x"))


def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.inertia(assigned(spark, sf_dir)).select(F.round("inertia", 6).alias("inertia"))


def kmeanspp_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = desc_of(spark, sf_dir)
    first = desc.orderBy("vec_id").select("vec").limit(1).collect()[0]["vec"]
    return cluster.nearest_seed(desc, [first]).select("vec_id", F.round("min_sq", 6).alias("min_sq"))


def flat_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = desc_of(spark, sf_dir)
    codebook = cluster.train_codebook(desc, 16)
    return cluster.assign(desc, codebook).groupBy("word_id").agg(F.count("*").alias("n"), F.round(F.sum("sq"), 6).alias("sq"))


def bow_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bow.histogram(assigned(spark, sf_dir))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bow.members(assigned(spark, sf_dir))
    return rows.select("image_id", "word_id", F.array_join(F.transform("kps", lambda k: k.cast("string")), ",").alias("kps"))


def _bow(weighting: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return image_bow(spark, sf_dir, weighting).select("image_id", "word_id", F.round("value", 6).alias("value"))

    run.__name__ = f"bow_{weighting.replace('_', '')}"
    return run


def _bow_sql(value: str, where: str = "") -> str:
    return f"""WITH {BOW}, v AS (SELECT image_id, word_id, {value} AS value FROM h JOIN w USING (word_id) {where})
SELECT image_id, word_id, round(value / sum(value) OVER (PARTITION BY image_id), 6) AS value FROM v"""


def _normalize(norm: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = bow.histogram(assigned(spark, sf_dir)).select("image_id", "word_id", F.col("n").cast("double").alias("value"))
        return bow.normalize(words, norm).select("image_id", "word_id", F.round("value", 6).alias("value"))

    run.__name__ = f"normalize_{norm}"
    return run


def _tree(desc: DataFrame) -> DataFrame:
    """A deterministic tree of two levels: labels, then labels by the parity of the vector's id."""
    one = cluster.means(desc, "label").select((F.col("word_id") + 1).cast("int").alias("node_id"), F.lit(0).alias("parent_id"), F.lit(1).alias("level"), "centroid")
    key = (2 * F.col("label") + F.col("vec_id") % 2).cast("int")
    two = cluster.means(desc.withColumn("key", key), "key").select((F.col("word_id") + 100).cast("int").alias("node_id"), (F.floor(F.col("word_id") / 2) + 1).cast("int").alias("parent_id"), F.lit(2).alias("level"), "centroid")
    root = desc.sparkSession.createDataFrame([(0, None, 0, None)], "node_id int, parent_id int, level int, centroid array<double>")
    nodes = staged(root.unionByName(one).unionByName(two), "tree")
    return tree.create_words(nodes.withColumn("word_id", F.lit(None).cast("int"))).withColumn("weight", F.lit(1.0))


def tree_level_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = desc_of(spark, sf_dir)
    return tree.descend(desc, _tree(desc), levels_up=1).select("vec_id", "node_id", "ancestor")


def tree_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(desc_of(spark, sf_dir)).where("word_id is not null").select("node_id", "parent_id", "word_id")


def _node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = desc_of(spark, sf_dir)
    nodes = _tree(desc)
    leaves = tree.descend(desc, nodes).select("image_id", F.col("node_id").alias("leaf"))
    return staged(tree.node_counts(leaves, tree.ancestors(nodes, 2)), "node_counts")


def node_path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_counts(spark, sf_dir)


def _node_weights(counts: DataFrame) -> DataFrame:
    return bow.word_weights(counts, "tf_idf", "node_id")


def node_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _node_weights(_node_counts(spark, sf_dir)).select("node_id", F.round("weight", 6).alias("weight"))


def node_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bow.document_frequency(_node_counts(spark, sf_dir), "node_id")


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _node_counts(spark, sf_dir)
    return tree.node_vectors(counts, _node_weights(counts)).select("image_id", "node_id", F.round("value", 6).alias("value"))


def hkmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tree.train_tree(desc_of(spark, sf_dir), depth=2, split=4)
    return nodes.select("node_id", "parent_id", "level", F.round("weight", 6).alias("weight"), "word_id")


QUERIES = {
    f.__name__: f
    for f in (
        sq_l2_pairs, dot_pairs, l2_normalize, dense_to_sparse, flatten_rows, reshape_rows, concat_rows, cluster_mean, nearest_centroid, lloyd_step, inertia,
        kmeanspp_distances, flat_kmeans, bow_histogram, cluster_members, _bow("tf"), _bow("tf_idf"), _bow("idf"), _bow("binary"), _normalize("l1"), _normalize("l2"),
        tree_level_assign, tree_words, node_path_counts, node_weights, node_document_frequency, node_vectors, hkmeans_tree,
    )
}

ORACLES = {
    "sq_l2_pairs": _pair_sql("(a.x - b.x) * (a.x - b.x)"),
    "dot_pairs": _pair_sql("a.x * b.x"),
    "l2_normalize": f"WITH {DESC} SELECT vec_id, dim, round(x * (vec_id + 1) / sqrt(sum(x * (vec_id + 1) * x * (vec_id + 1)) OVER (PARTITION BY vec_id)), 6) AS x FROM e",
    "dense_to_sparse": f"WITH {DESC} SELECT vec_id, dim AS idx, round(floor(x * 10) / 10, 6) AS value FROM e WHERE floor(x * 10) <> 0",
    "flatten_rows": f"WITH {DESC} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY kp_id, dim) - 1 AS INTEGER) AS pos, round(x, 6) AS x FROM e",
    "reshape_rows": f"WITH {DESC} SELECT vec_id, dim // 8 AS row_id, round(sum(x), 6) AS row_sum FROM e GROUP BY ALL",
    "concat_rows": f"WITH {DESC} SELECT label % 2 AS part, vec_id, round(sum(x), 6) AS row_sum FROM e GROUP BY ALL",
    "cluster_mean": f"WITH {ASSIGNED} SELECT word_id, dim, round(x, 6) AS x FROM c",
    "nearest_centroid": f"WITH {ASSIGNED} SELECT vec_id, word_id, round(sq, 6) AS sq FROM a",
    "lloyd_step": f"""WITH {ASSIGNED}, f AS (SELECT a.word_id, e.dim, avg(e.x) AS x FROM a JOIN e USING (vec_id) GROUP BY ALL)
SELECT c.word_id, c.dim, round(coalesce(f.x, c.x), 6) AS x FROM c LEFT JOIN f USING (word_id, dim)""",
    "inertia": f"WITH {ASSIGNED} SELECT round(sum(sq), 6) AS inertia FROM a",
    "kmeanspp_distances": f"WITH {DESC} SELECT e.vec_id, round(sum((e.x - s.x) * (e.x - s.x)), 6) AS min_sq FROM e JOIN (SELECT dim, x FROM e WHERE vec_id = (SELECT min(vec_id) FROM d)) s USING (dim) GROUP BY ALL",
    "bow_histogram": f"WITH {BOW} SELECT image_id, word_id, n FROM h",
    "cluster_members": f"WITH {ASSIGNED} SELECT image_id, word_id, string_agg(CAST(kp_id AS VARCHAR), ',' ORDER BY kp_id) AS kps FROM a GROUP BY ALL",
    "bow_tf": _bow_sql("h.n * 1.0"),
    "bow_tfidf": _bow_sql("h.n * w.weight", "WHERE w.weight > 0"),
    "bow_idf": _bow_sql("w.weight", "WHERE w.weight > 0"),
    "bow_binary": _bow_sql("1.0"),
    "normalize_l1": f"WITH {BOW} SELECT image_id, word_id, round(n / sum(n * 1.0) OVER (PARTITION BY image_id), 6) AS value FROM h",
    "normalize_l2": f"WITH {BOW} SELECT image_id, word_id, round(n / sqrt(sum(n * n * 1.0) OVER (PARTITION BY image_id)), 6) AS value FROM h",
    "tree_level_assign": f"WITH {TREE} SELECT vec_id, CAST(node_id AS INTEGER) AS node_id, CAST(top AS INTEGER) AS ancestor FROM s2",
    "tree_words": f"WITH {TREE}, l AS (SELECT DISTINCT node_id, parent_id FROM c2) SELECT CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, CAST(row_number() OVER (ORDER BY node_id) - 1 AS INTEGER) AS word_id FROM l",
    "node_path_counts": f"WITH {TREE} SELECT image_id, node_id, n FROM nc",
    "node_weights": f"WITH {TREE} SELECT node_id, round(weight, 6) AS weight FROM nw",
    "node_document_frequency": f"WITH {TREE} SELECT node_id, count(*) AS df FROM nc GROUP BY node_id",
    "node_vectors": f"""WITH {TREE}, v AS (SELECT image_id, node_id, n * weight AS value FROM nc JOIN nw USING (node_id)),
s AS (SELECT image_id, sqrt(sum(value * value)) AS s FROM v GROUP BY image_id)
SELECT image_id, node_id, round(CASE WHEN s > 0 THEN value / s ELSE 0 END, 6) AS value FROM v JOIN s USING (image_id)""",
}
