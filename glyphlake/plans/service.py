"""Queries on names, users, collections, pixels and the registry: customers as users, orders as their images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions import scalars
from glyphlake.operators import collections, imageops, registry
from glyphlake.operators.cluster import feature_cap as cap_features
from glyphlake.plans.vocabulary import DESC, desc_of
from glyphlake.sources import formats, tables
from glyphlake.sources.tables import read
from glyphlake.streaming.ingest import latest_actions

USERS = """u AS (SELECT lower(c_name) || '@example.com' AS email, c_acctbal, c_mktsegment, c_custkey FROM customer),
known AS (SELECT email FROM u WHERE c_acctbal >= 0),
o AS (SELECT lower(c_name) || '@example.com' AS email, 'images/' || o_orderkey || '.jpg' AS path, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
im AS (SELECT email, path, row_number() OVER (PARTITION BY email ORDER BY path) - 1 AS image_id, o_orderpriority FROM o WHERE o_orderstatus = 'F')"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").withColumn("email", F.concat(F.lower("c_name"), F.lit("@example.com")))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).where("c_acctbal >= 0").select("email", collections.user_id(F.col("email")).alias("user_id"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "orders").join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return both.withColumn("path", F.concat(F.lit("images/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("email").orderBy("path")
    return _orders(spark, sf_dir).where("o_orderstatus = 'F'").select("email", "path", (F.row_number().over(order) - 1).cast("long").alias("image_id"), "o_orderpriority")


def add_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.add_users(_known(spark, sf_dir), _customers(spark, sf_dir))[1]


def find_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _customers(spark, sf_dir).where("c_mktsegment = 'BUILDING'").select("email", F.lit(None).cast("long").alias("user_id"))
    return collections.find_users(_known(spark, sf_dir), keys).select("email")


def delete_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.delete_users(_known(spark, sf_dir), _customers(spark, sf_dir).where("c_mktsegment = 'BUILDING'"))[1]


def users_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.delete_users(_known(spark, sf_dir), _customers(spark, sf_dir).where("c_mktsegment = 'BUILDING'"))[0].select("email")


def user_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.locations(_known(spark, sf_dir), _customers(spark, sf_dir))


def add_image_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.add_images(_known(spark, sf_dir), _images(spark, sf_dir), _orders(spark, sf_dir))[1]


def remove_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return collections.remove_images(images, images.where("o_orderpriority = '1-URGENT'"))[0].select("email", "path", "image_id")


def list_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.counts(_images(spark, sf_dir))


def image_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return collections.lookup(images, images.where("o_orderpriority = '1-URGENT'")).select("email", "image_id", "path")


def feature_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("image_id")).distinct()
    return ids.select("image_id", scalars.feature_path(F.col("image_id"), "base", "akaze", "desc").alias("path"))


def file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", scalars.file_name(F.col("url")).alias("name"), scalars.base_name(F.col("url")).alias("stem"), scalars.image_location(F.lit("base"), scalars.file_name(F.col("url"))).alias("location"))


def group_of_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desc_of(spark, sf_dir).select("image_id").distinct().select("image_id", scalars.group_start(F.col("image_id")).alias("group_id"))


def epoch_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", scalars.epoch_seconds(F.col("ts")).alias("seconds"))


def number_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.number_images(read(spark, sf_dir, "pages"), "url")


def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.next_id(read(spark, sf_dir, "documents"), "doc_id")


def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.missing_features(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id").select("doc_id")


def vectors_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), read(spark, sf_dir, "embeddings")
    found = tables.vectors_or_empty(docs, vectors, "embedding", "array<float>", "vec_id")
    return found.select("vec_id", F.size("embedding").alias("dims"))


def feature_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the order of their keys until a third of all lines is reached."""
    lines = read(spark, sf_dir, "lineitem")
    orders = lines.groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count("*").alias("n"))
    return cap_features(orders, "n", int(lines.count() // 3))


def index_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_actions(read(spark, sf_dir, "events"), "user_id").select("user_id", "event_id", "event_type")


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imageops.pixels_of(read(spark, sf_dir, "embeddings").withColumn("vec", F.col("embedding").cast("array<double>")), "vec_id", "vec", 8)


def integral_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imageops.integral_image(_pixels(spark, sf_dir)).withColumn("s", F.round("s", 6))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") > 0.1, 1).otherwise(0))


def hough_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imageops.hough_votes(_edges(spark, sf_dir), 1.0, math.pi / 8)


def hough_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = imageops.hough_lines(_edges(spark, sf_dir), 1.0, math.pi / 8, 2)
    return lines.select("image_id", "rho", F.round("theta", 6).alias("theta"), "votes", "rank")


def to_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.floor(F.abs("v") * 255).cast("int")
    colour = _pixels(spark, sf_dir).select("image_id", "y", "x", level.alias("c0"), (level * 7 % 256).alias("c1"), (level * 13 % 256).alias("c2"))
    return imageops.to_gray(colour)


def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the tables' folder by their extension, each with its folder."""
    files = formats.list_files(spark, sf_dir, ".parquet")
    return files.select(scalars.base_name(F.col("path")).alias("name"), F.col("length")).where("length > 0")


def registry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.standard().describe(spark)


QUERIES = {
    f.__name__: f
    for f in (
        add_user, find_user, delete_user, users_left, user_location, add_image_status, remove_image, list_images, image_lookup, feature_path, file_name, group_of_four,
        epoch_seconds, number_images, next_id, missing_features, vectors_or_empty, feature_cap, index_actions, integral_image, hough_votes, hough_lines, to_gray, list_files, registry_list,
    )
}

_PIXELS = DESC + ", p AS (SELECT vec_id AS image_id, dim // 8 AS y, dim % 8 AS x, x AS v FROM e)"
_VOTES = _PIXELS + """,
v AS (SELECT image_id, CAST(floor(x * cos(t * pi() / 8) + y * sin(t * pi() / 8) + 0.5) AS INTEGER) AS rho_bin, CAST(t AS INTEGER) AS theta_bin, count(*) AS votes FROM p, range(8) r(t) WHERE v > 0.1 GROUP BY ALL)"""

ORACLES = {
    "add_user": f"WITH {USERS} SELECT DISTINCT email, CASE WHEN email IN (SELECT email FROM known) THEN 'already exists' ELSE 'added' END AS status FROM u",
    "find_user": f"WITH {USERS} SELECT email FROM u WHERE c_acctbal >= 0 AND c_mktsegment = 'BUILDING'",
    "delete_user": f"WITH {USERS} SELECT email, CASE WHEN email IN (SELECT email FROM known) THEN 'deleted' ELSE 'unknown user' END AS status FROM u WHERE c_mktsegment = 'BUILDING'",
    "users_left": f"WITH {USERS} SELECT email FROM u WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'",
    "user_location": f"WITH {USERS} SELECT email, CASE WHEN email IN (SELECT email FROM known) THEN 'users/user_' || email ELSE '' END AS location FROM u",
    "add_image_status": f"""WITH {USERS}, mx AS (SELECT email, max(image_id) AS m FROM im GROUP BY email),
s AS (SELECT o.email, o.path, o.email IN (SELECT email FROM known) AS is_user, o_orderstatus = 'F' AS has FROM o)
SELECT s.email, path, CASE WHEN NOT is_user THEN -1 WHEN has THEN -2 ELSE coalesce(m, -1) + row_number() OVER (PARTITION BY s.email, is_user AND NOT has ORDER BY path) END AS image_id FROM s LEFT JOIN mx USING (email)""",
    "remove_image": f"WITH {USERS} SELECT email, path, image_id FROM im WHERE o_orderpriority <> '1-URGENT'",
    "list_images": f"WITH {USERS} SELECT email, count(*) AS images FROM im GROUP BY email",
    "image_lookup": f"WITH {USERS} SELECT email, image_id, path FROM im WHERE o_orderpriority = '1-URGENT'",
    "feature_path": """SELECT image_id, 'base/feats/akaze/desc/' || lpad(CAST(image_id >> 20 AS VARCHAR), 4, '0') || '/' || lpad(CAST((image_id - ((image_id >> 20) << 20)) >> 10 AS VARCHAR), 4, '0') || '/' || lpad(CAST(image_id AS VARCHAR), 9, '0') || '.desc' AS path
FROM (SELECT DISTINCT l_partkey * 1000 + l_suppkey AS image_id FROM lineitem)""",
    "file_name": """SELECT page_id, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, 'base/images/' || name AS location FROM (SELECT page_id, CASE WHEN contains(url, '/') THEN split_part(url, '/', -1) ELSE split_part(url, '\\', -1) END AS name FROM pages)""",
    "group_of_four": f"WITH {DESC} SELECT DISTINCT image_id, image_id // 4 * 4 AS group_id FROM d",
    "epoch_seconds": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events",
    "number_images": "SELECT row_number() OVER (ORDER BY url) - 1 AS image_id, url FROM (SELECT DISTINCT url FROM pages)",
    "next_id": "SELECT coalesce(max(doc_id), -1) + 1 AS next_id FROM documents",
    "missing_features": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "vectors_or_empty": "SELECT doc_id AS vec_id, CAST(coalesce(len(embedding), 0) AS INTEGER) AS dims FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "feature_cap": """SELECT image_id, n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT l_orderkey AS image_id, count(*) AS n FROM lineitem GROUP BY l_orderkey))
WHERE before < (SELECT count(*) // 3 FROM lineitem)""",
    "index_actions": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "integral_image": f"""WITH {_PIXELS}, rs AS (SELECT image_id, y, x, sum(v) OVER (PARTITION BY image_id, y ORDER BY x) AS r FROM p)
SELECT image_id, CAST(y + 1 AS INTEGER) AS y, CAST(x + 1 AS INTEGER) AS x, round(sum(r) OVER (PARTITION BY image_id, x ORDER BY y), 6) AS s FROM rs
UNION ALL SELECT DISTINCT image_id, CAST(y + 1 AS INTEGER), 0, 0.0 FROM p UNION ALL SELECT DISTINCT image_id, 0, CAST(x + 1 AS INTEGER), 0.0 FROM p UNION ALL SELECT DISTINCT image_id, 0, 0, 0.0 FROM p""",
    "hough_votes": f"WITH {_VOTES} SELECT image_id, rho_bin, theta_bin, votes FROM v",
    "hough_lines": f"""WITH {_VOTES}, k AS (SELECT v.*, coalesce(a.votes, 0) AS br, coalesce(b.votes, 0) AS ar, coalesce(c.votes, 0) AS bt, coalesce(f.votes, 0) AS ft FROM v
LEFT JOIN v a ON a.image_id = v.image_id AND a.theta_bin = v.theta_bin AND a.rho_bin = v.rho_bin - 1 LEFT JOIN v b ON b.image_id = v.image_id AND b.theta_bin = v.theta_bin AND b.rho_bin = v.rho_bin + 1
LEFT JOIN v c ON c.image_id = v.image_id AND c.rho_bin = v.rho_bin AND c.theta_bin = v.theta_bin - 1 LEFT JOIN v f ON f.image_id = v.image_id AND f.rho_bin = v.rho_bin AND f.theta_bin = v.theta_bin + 1)
SELECT image_id, CAST(rho_bin AS DOUBLE) AS rho, round(theta_bin * pi() / 8, 6) AS theta, votes, CAST(row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, rho_bin, theta_bin) AS INTEGER) AS rank FROM k WHERE votes > 2 AND votes > br AND votes >= ar AND votes > bt AND votes >= ft""",
    "to_gray": f"""WITH {_PIXELS}, l AS (SELECT image_id, y, x, CAST(floor(abs(v) * 255) AS INTEGER) AS c FROM p)
SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(least(255, greatest(0, floor(c * 0.299::DOUBLE + (c * 7 % 256) * 0.587::DOUBLE + (c * 13 % 256) * 0.114::DOUBLE + 0.5))) AS INTEGER) AS v FROM l""",
}
