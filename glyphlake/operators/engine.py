"""Whole requests in one plan (I4, Q3, U2, U6, U8, U9, E3), and the stored forms of trees, indexes and user lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.operators import bow, collections, evaluate, index, report, search, verify

#: Results that a request ranks, and those that it verifies.
RETURNED, VERIFIED = 64, 10

TREE = "node_id int, parent_id int, level int, centroid array<double>, weight double, word_id int"
POSTINGS = "word_id int, image_id long, weight double"
USERS = "email string, user_id string"


def _stored(spark: SparkSession, path: str, ddl: str, form: str = "parquet") -> DataFrame:
    """A stored table, which must have the columns of ddl."""
    wanted = spark.createDataFrame([], ddl).schema
    found = spark.read.format(form).load(path)
    missing = [f"{f.name} {f.dataType.simpleString()}" for f in wanted if f.name not in found.columns or found.schema[f.name].dataType.simpleString() != f.dataType.simpleString()]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return found.select(*wanted.names)


def save_tree(nodes: DataFrame, path: str) -> None:
    """K3: a tree with its words and weights, without loss."""
    nodes.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in TREE.split(", ")]).write.mode("overwrite").parquet(path)


def load_tree(spark: SparkSession, path: str) -> DataFrame:
    """The inverse; a table of other columns, and one without words, is refused."""
    nodes = _stored(spark, path, TREE)
    if nodes.where("word_id is not null").isEmpty():
        raise ValueError(f"{path} has no words")
    return nodes


def save_index(postings: DataFrame, path: str) -> None:
    """K5: the index, its files sorted by word, so that a search for few words reads few row groups."""
    rows = postings.select(F.col("word_id").cast("int").alias("word_id"), F.col("image_id").cast("long").alias("image_id"), F.col("weight").cast("double").alias("weight"))
    rows.repartitionByRange("word_id", "image_id").sortWithinPartitions("word_id", "image_id").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The inverse; a table of other columns is refused."""
    return _stored(spark, path, POSTINGS)


def save_users(users: DataFrame, path: str) -> None:
    """K9: the list of users as compressed lines of JSON, ids as strings."""
    users.select("email", F.col("user_id").cast("string").alias("user_id")).write.mode("overwrite").option("compression", "gzip").json(path)


def load_users(spark: SparkSession, path: str) -> DataFrame:
    """The inverse, ids as numbers; lines without an email go."""
    return spark.read.schema(USERS).json(path).where("email is not null").select("email", F.col("user_id").cast("long").alias("user_id"))


def add_numeric_users(users: DataFrame, numbers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users with those that the numbers (user_id) stand for, and (user_id, email, status)."""
    named = numbers.where("user_id is not null").select("user_id", collections.email_of(F.col("user_id")).alias("email")).distinct()
    left, status = collections.add_users(users, named)
    return left, named.join(status, "email").select("user_id", "email", "status")


def vectors_of(words: DataFrame, weights: DataFrame) -> DataFrame:
    """A2: normalised vectors (image_id, word_id, value) of images, from rows of (image_id, word_id) and the vocabulary's stored weights."""
    return bow.normalize(bow.transform(bow.histogram(words), weights))


def index_images(postings: DataFrame, words: DataFrame, weights: DataFrame) -> DataFrame:
    """I4: the index with further images, from their words and the weights that the vocabulary was stored with.

    Images that are in the index keep their postings. The weights stay as they are, as those of the images before them.
    """
    return index.add_images(postings, vectors_of(words, weights))


def add_user_images(users: DataFrame, images: DataFrame, requests: DataFrame, postings: DataFrame, words: DataFrame, weights: DataFrame, high: DataFrame | None = None):
    """U6 with I4: (images, postings by user, status) after requests (email, path).

    words: (path, word_id) of the requested files. Only requests that give out an id reach the index.
    """
    left, status = collections.add_images(users, images, requests, high)
    added = status.where("image_id >= 0")
    # A user's images have ids of their own, so vectors are those of (email, image).
    own = added.join(words, "path").select(F.struct("email", "image_id").alias("image_id"), "word_id")
    vectors = vectors_of(own, weights).select("image_id.email", "image_id.image_id", "word_id", F.col("value").alias("weight"))
    return left, postings.select("email", "image_id", "word_id", "weight").unionByName(vectors), status


def matched(queries: DataFrame, postings: DataFrame, desc: DataFrame, asked: DataFrame, top: int = RETURNED, verified: int = VERIFIED, alike: bool = False) -> tuple[DataFrame, DataFrame]:
    """Q3: ranked results of the queries' vectors, and point matches of the first ``verified`` of each.

    desc: (image_id, kp_id, vec) of the indexed images, asked: of the queries. Descriptors of the few images to verify are joined by id.
    alike: see ``search``.
    """
    ranked = search.search(queries, postings, "l1", top, alike=alike)
    pairs = ranked.where(F.col("rank") <= verified).select("query_id", "image_id")
    return ranked, verify.ratio_matches(pairs, desc, asked)


def retrieve(queries: DataFrame, postings: DataFrame, desc: DataFrame, keypoints: DataFrame, images: DataFrame, asked: DataFrame | None = None, asked_points: DataFrame | None = None, topn: int | None = None) -> DataFrame:
    """(query_id, names): search, point matches, fundamental matrices, and the names of the results that these verify.

    Without topn the names of verified results among the first VERIFIED, with it of the first topn whether verified or not.
    Queries without results have no row.
    """
    ranked, matches = matched(queries, postings, desc, desc if asked is None else asked)
    verdicts = verify.verify(matches, keypoints, "f", asked=asked_points)
    return collections.retrieve(verify.validate_top(ranked, verdicts, VERIFIED), images, topn)


def evaluation(ranked: DataFrame, verdicts: DataFrame, names: DataFrame, top: int = VERIFIED) -> DataFrame:
    """A row per query of one batch of searches: its group score (E1), results verified (G5) and its row of the match page."""
    marked = verify.validate_top(ranked, verdicts, top)
    verified = marked.groupBy("query_id").agg(F.count(F.when(F.col("mark") > 0, 1)).alias("verified"))
    return evaluate.group_score(ranked).join(verified, "query_id").join(report.match_rows(marked, names), "query_id")
