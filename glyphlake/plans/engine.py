"""Queries that run whole requests: images added to a stored index, retrieval, evaluation, and stored trees, indexes and user lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.operators import bow, cluster, engine, index, tree, verify
from glyphlake.plans.retrieval import _MATCHES, SCORED, _names, flagship
from glyphlake.plans.vocabulary import ASSIGNED, TREE, _tree, assigned, desc_of, image_bow
from glyphlake.sources.tables import read, shared_folder

#: Images below this id are in the index before the others are added.
FIRST = 60


def _folder(spark: SparkSession, name: str) -> str:
    context = spark.sparkContext
    return f"{shared_folder(spark.conf.get('spark.checkpoint.dir', None), context.master, context.applicationId)}/glyphlake/{uuid.uuid4().hex}/{name}"


def index_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and weights of the first images make the index; the others are added with these weights."""
    words = assigned(spark, sf_dir).select("image_id", "word_id")
    first = words.where(F.col("image_id") < FIRST)
    weights = bow.word_weights(bow.histogram(first))
    path = _folder(spark, "index")
    engine.save_index(index.build_index(engine.vectors_of(first, weights)), path)
    return engine.index_images(engine.load_index(spark, path), words, weights).select("word_id", "image_id", F.round("weight", 6).alias("weight"))


def stored_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree with its words and weights, stored, loaded and descended."""
    desc = desc_of(spark, sf_dir)
    path = _folder(spark, "tree")
    engine.save_tree(tree.weigh(_tree(desc), desc), path)
    found = tree.descend(desc, engine.load_tree(spark, path))
    return found.select("vec_id", "node_id", "word_id", F.round("weight", 6).alias("weight"))


def stored_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "users")
    engine.save_users(read(spark, sf_dir, "customer").select(F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"), F.col("c_custkey").alias("user_id")), path)
    return engine.load_users(spark, path)


def add_numeric_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    known = customers.where("c_acctbal >= 0").select(F.concat(F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"), "user_id")
    return engine.add_numeric_users(known, customers.select("user_id"))[1]


def retrieve_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image searched among all; of its first ten results how many points match."""
    desc, vectors = desc_of(spark, sf_dir), image_bow(spark, sf_dir)
    ranked, matches = engine.matched(vectors, index.build_index(vectors), desc, desc, alike=True)
    counted = matches.groupBy("query_id", "image_id").agg(F.count("*").alias("n"))
    near = ranked.where(F.col("rank") <= engine.VERIFIED).join(counted, ["query_id", "image_id"], "left")
    return near.select("query_id", "image_id", "rank", F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"))


def _points(desc: DataFrame) -> DataFrame:
    return desc.select("image_id", "kp_id", (F.col("vec")[0] * 500 + 250).alias("x"), (F.col("vec")[1] * 500 + 250).alias("y"))


def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 25 points, every second one a copy of the one before it."""
    desc = desc_of(spark, sf_dir)
    one = desc.select(F.col("vec_id"), (F.floor(F.col("vec_id") / 25) * 2).cast("long").alias("image_id"), (F.col("vec_id") % 25).cast("int").alias("kp_id"), "vec", "label")
    return one.unionByName(one.withColumn("image_id", F.col("image_id") + 1))


def retrieve_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From descriptors to the names of verified results, in one plan."""
    desc = _large(spark, sf_dir)
    words = cluster.assign(desc, cluster.means(desc, "label")).select("image_id", "word_id")
    vectors = engine.vectors_of(words, bow.word_weights(bow.histogram(words)))
    names = desc.select("image_id", F.concat(F.lit("images/"), F.lpad(F.col("image_id").cast("string"), 5, "0"), F.lit(".jpg")).alias("path")).distinct()
    return engine.retrieve(vectors, index.build_index(vectors), desc, _points(desc), names)


def evaluate_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation of a batch: results with a matching point count as verified."""
    desc, ranked = desc_of(spark, sf_dir), flagship(spark, sf_dir)
    matches = verify.ratio_matches(ranked.where("rank <= 3").select("query_id", "image_id"), desc)
    verdicts = matches.select("query_id", "image_id").distinct().withColumn("good", F.lit(True))
    return engine.evaluation(ranked, verdicts, _names(spark, sf_dir), 3).select("query_id", "group_score", "verified", "html")


QUERIES = {f.__name__: f for f in (index_added, stored_tree, stored_users, add_numeric_user, retrieve_matches, retrieve_images, evaluate_searches)}

# The matches of pairs of a table p (query_id, image_id) instead of those of a group.
_PAIR_MATCHES = _MATCHES.replace("FROM e q JOIN e i ON q.image_id // 4 = i.image_id // 4 AND q.image_id <> i.image_id AND q.dim = i.dim", "FROM p JOIN e q ON q.image_id = p.query_id JOIN e i ON i.image_id = p.image_id AND q.dim = i.dim")
_MATCHED = "mt AS (SELECT query_id, image_id, count(*) AS n FROM (SELECT query_id, image_id, kp_q, kp_t FROM r1 WHERE rn = 1 AND sq < 0.64 * nx UNION SELECT query_id, image_id, kp_q, kp_t FROM r2 WHERE rn = 1 AND sq < 0.64 * nx) GROUP BY ALL)"

ORACLES = {
    "index_added": f"""WITH {ASSIGNED}, h AS (SELECT image_id, word_id, count(*) AS n FROM a GROUP BY ALL),
w AS (SELECT word_id, ln((SELECT count(DISTINCT image_id) FROM h WHERE image_id < {FIRST}) * 1.0 / count(DISTINCT image_id)) AS weight FROM h WHERE image_id < {FIRST} GROUP BY word_id),
b0 AS (SELECT image_id, word_id, h.n * w.weight AS value FROM h JOIN w USING (word_id) WHERE weight > 0)
SELECT word_id, image_id, round(value / sum(value) OVER (PARTITION BY image_id), 6) AS weight FROM b0""",
    "stored_tree": f"""WITH {TREE}, l AS (SELECT CAST(node_id AS INTEGER) AS node_id, CAST(row_number() OVER (ORDER BY node_id) - 1 AS INTEGER) AS word_id FROM (SELECT DISTINCT node_id FROM c2)),
lw AS (SELECT node_id, ln((SELECT count(DISTINCT image_id) FROM s2) * 1.0 / count(DISTINCT image_id)) AS weight FROM s2 GROUP BY node_id)
SELECT vec_id, CAST(s2.node_id AS INTEGER) AS node_id, word_id, round(weight, 6) AS weight FROM s2 JOIN l USING (node_id) JOIN lw USING (node_id)""",
    "stored_users": "SELECT lower(c_name) || '@example.com' AS email, c_custkey AS user_id FROM customer",
    "add_numeric_user": "SELECT c_custkey AS user_id, c_custkey || '@example.com' AS email, CASE WHEN c_acctbal >= 0 THEN 'already exists' ELSE 'added' END AS status FROM customer",
    "retrieve_matches": f"""WITH {SCORED.partition("r AS (")[0]} r AS (SELECT query_id, image_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), image_id) AS INTEGER) AS rank FROM sc),
p AS (SELECT query_id, image_id, rank FROM r WHERE rank <= 10), {_PAIR_MATCHES}, {_MATCHED}
SELECT p.query_id, p.image_id, p.rank, coalesce(mt.n, 0) AS n_matches FROM p LEFT JOIN mt USING (query_id, image_id)""",
    "evaluate_searches": f"""WITH {SCORED}, p AS (SELECT query_id, image_id FROM r WHERE rank <= 3), {_PAIR_MATCHES}, {_MATCHED},
m AS (SELECT r.query_id, r.image_id, r.rank, CASE WHEN r.rank > 3 THEN 0 WHEN mt.n > 0 THEN 1 ELSE -1 END AS mark, lpad(CAST(r.image_id AS VARCHAR), 5, '0') || '.jpg' AS name FROM r LEFT JOIN mt USING (query_id, image_id))
SELECT query_id, CAST(sum(CASE WHEN rank <= 4 AND query_id // 4 = image_id // 4 THEN 1 ELSE 0 END) AS BIGINT) AS group_score, count(*) FILTER (WHERE mark > 0) AS verified,
'<tr>' || string_agg('<td style="border:3px solid ' || CASE WHEN mark > 0 THEN 'green' WHEN mark < 0 THEN 'red' ELSE 'black' END || '"><img src="' || name || '"/></td>', '' ORDER BY rank) || '</tr>' AS html FROM m GROUP BY query_id""",
}
