"""Queries on the index, search, evaluation and verification: images from ``embeddings``, text images from ``documents``.

Searches over documents take every hundredth document as a query against all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.scalars import bow_line, match_line, result_csv
from glyphlake.operators import bow, evaluate, index, report, search, sweep, tree, verify
from glyphlake.plans.vocabulary import BOW, DESC, TOKENS, TREE, _node_counts, _node_weights, desc_of, image_bow
from glyphlake.sources.tables import read, staged, token_bags, tokens

#: The documents that are searched for.
ASKED = "image_id % 100 = 0"
TEXT_BOW = TOKENS + """,
tb0 AS (SELECT image_id, word, n * weight AS value FROM t JOIN tw USING (word) WHERE weight > 0),
tb AS (SELECT image_id, word, value / sum(value) OVER (PARTITION BY image_id) AS value FROM tb0)"""
SCORED = BOW + """,
sc AS (SELECT q.image_id AS query_id, d.image_id, sum(abs(q.value - d.value) - abs(q.value) - abs(d.value)) AS score FROM b q JOIN b d USING (word_id) GROUP BY ALL),
r AS (SELECT query_id, image_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), image_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 4)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, counted once and written: their number, frequencies and vectors all come from them."""
    return staged(tokens(read(spark, sf_dir, "documents")), "words")


def _text_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    return bow.normalize(bow.transform(words, bow.word_weights(words, "tf_idf", "word"), "tf_idf", "word"))


def _text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bag, written: queries and postings both come from it."""
    return staged(_text_bow(spark, sf_dir), "vectors")


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words, a row for each document: searches read them whole and move none."""
    return token_bags(read(spark, sf_dir, "documents"))


def _out(scored: DataFrame, value: str = "score") -> DataFrame:
    return scored.withColumn(value, F.round(value, 6))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image searched among all images: words, tf-idf, L1 score, the best four."""
    vectors = image_bow(spark, sf_dir)
    return _out(search.search(vectors, index.build_index(vectors), "l1", top=4, alike=True))


def idf_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    n = words.agg(F.count_distinct("image_id")).collect()[0][0]
    return bow.idf(bow.document_frequency(words, "word"), n, "word").select("word", F.round("idf", 6).alias("idf"))


def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual words that every image has weigh nothing; so do tokens of every document."""
    return bow.stop_words(bow.word_weights(_node_counts(spark, sf_dir), "tf_idf", "node_id")).select("node_id")


def bow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_text_bow(spark, sf_dir), "value")


def _posted(postings: DataFrame) -> DataFrame:
    return postings.select("word", "image_id", F.round("weight", 6).alias("weight"))


def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posted(index.build_index(_text_bow(spark, sf_dir), "word"))


def postings_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents added to an index of the labelled ones."""
    vectors = _text_vectors(spark, sf_dir)
    labelled = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"))
    return _posted(index.add_images(index.build_index(vectors.join(labelled, "image_id", "left_semi"), "word"), vectors, "word"))


def postings_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled toxic removed from the index of all."""
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("image_id"))
    return _posted(index.remove_images(index.build_index(_text_bow(spark, sf_dir), "word"), toxic))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.entries(index.build_index(_text_bow(spark, sf_dir), "word"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search.search_bags(_bags(spark, sf_dir), ASKED, "l1", top=10))


def l1_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = image_bow(spark, sf_dir)
    return search.by_class(vectors, index.build_index(vectors), lambda q, d: _out(search.score_l1_similarity(q, d)))


def l1_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = image_bow(spark, sf_dir)
    return search.by_class(vectors, index.build_index(vectors), lambda q, d: _out(search.full_l1(q, d), "distance"))


def candidate_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = _bags(spark, sf_dir)
    return sweep.most_shared(bags.where(ASKED), bags, 64)


def search_min_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search.search_bags(_bags(spark, sf_dir), ASKED, "min_hist", top=10))


def cosine_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(search.search_bags(_bags(spark, sf_dir), ASKED, "cosine", top=10))


def search_node_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _node_counts(spark, sf_dir)
    vectors = staged(tree.node_vectors(counts, _node_weights(counts)).where("value > 0"), "node_vectors")
    return _out(search.search_nodes(vectors, vectors, None, 4))


def search_node_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with few entries: the leaves with the query's greatest values come first."""
    counts = _node_counts(spark, sf_dir)
    vectors = staged(tree.node_vectors(counts, _node_weights(counts)).where("value > 0"), "node_vectors")
    return _out(search.search_nodes(vectors, vectors, 25, 4, vectors.select("node_id").where("node_id >= 100").distinct()))


def group_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.group_score(flagship(spark, sf_dir))


def mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = desc_of(spark, sf_dir).select(F.col("image_id").alias("query_id"))
    return _out(evaluate.mean_score(asked, group_score(spark, sf_dir)), "mean_score")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ground_truth(desc_of(spark, sf_dir).select("image_id").distinct())


def ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key points of the images of one group matched with each other."""
    desc = desc_of(spark, sf_dir)
    return verify.ratio_matches(_group_pairs(desc), desc)


def _group_pairs(desc: DataFrame) -> DataFrame:
    ids = desc.select("image_id", F.floor(F.col("image_id") / 4).alias("g")).distinct()
    return ids.select(F.col("image_id").alias("query_id"), "g").join(ids, "g").where("query_id <> image_id").drop("g")


def ransac_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points made from vectors and their shifted copies: pairs of images that a homography relates."""
    desc = desc_of(spark, sf_dir)
    image, point = F.floor(F.col("image_id") / 8) * 2, (F.col("image_id") % 8) * 5 + F.col("kp_id")
    one = desc.select(image.cast("long").alias("image_id"), point.cast("int").alias("kp_id"), (F.col("vec")[0] * 500 + 250).alias("x"), (F.col("vec")[1] * 500 + 250).alias("y"))
    two = one.select((F.col("image_id") + 1).alias("image_id"), "kp_id", (F.col("x") * 0.9 + 12).alias("x"), (F.col("y") * 1.1 - 7).alias("y"))
    matches = one.select(F.col("image_id").alias("query_id"), (F.col("image_id") + 1).alias("image_id"), F.col("kp_id").alias("kp_q"), F.col("kp_id").alias("kp_t"))
    return verify.verify(matches, one.unionByName(two), "h").withColumn("confidence", F.round("confidence", 6))


def good_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in the role of inliers, of matches of five lines each."""
    lines = read(spark, sf_dir, "lineitem")
    inliers, matches = F.col("l_quantity").cast("int"), (F.col("l_quantity") + 5 * F.col("l_linenumber")).cast("int")
    conf = verify.confidence(inliers, matches)
    return lines.select("l_orderkey", "l_linenumber", F.round(conf, 6).alias("confidence"), verify.is_good(inliers, conf).alias("good"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = flagship(spark, sf_dir)
    verdicts = ranked.select("query_id", "image_id", (F.col("score") < -1.5).alias("good"))
    return verify.validate_top(ranked, verdicts, 3)


def validate_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("query_id", "image_id", "rank", "mark")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desc_of(spark, sf_dir).select("image_id", F.concat(F.lpad(F.col("image_id").cast("string"), 5, "0"), F.lit(".jpg")).alias("name")).distinct()


def result_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marked(spark, sf_dir).join(_names(spark, sf_dir), "image_id")
    best = F.array_sort(F.collect_list(F.when(F.col("mark") > 0, F.struct("rank", "name"))))
    return rows.groupBy("query_id").agg(result_csv(F.transform(best, lambda r: r["name"])).alias("names"))


def match_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.match_rows(_marked(spark, sf_dir), _names(spark, sf_dir))


def match_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages of match rows; of each page its number of rows and its length."""
    whole = report.pages(match_page_rows(spark, sf_dir))
    return whole.select("page", F.size(F.split("html", "<tr>")).alias("parts"), F.length("html").alias("chars"))


def bow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's vector in print, and as a dense line of the codebook's words."""
    vectors = image_bow(spark, sf_dir)
    pairs = F.array_sort(F.collect_list(F.struct("word_id", "value")))
    printed = vectors.groupBy("image_id").agg(pairs.alias("pairs")).select("image_id", bow_line(F.col("pairs")).alias("printed"))
    return printed.join(bow.dense_lines(vectors, 10), "image_id")


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first results of each query in short form."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "image_id")))
    return flagship(spark, sf_dir).groupBy("query_id").agg(rows.alias("r")).select("query_id", match_line(F.transform("r", lambda x: x["image_id"])).alias("line"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship, idf_flat, stop_words, bow_documents, postings_build, postings_add, postings_remove, index_entries, search_documents, l1_similarity, l1_distance,
        candidate_cutoff, search_min_hist, cosine_sim, search_node_l2, search_node_cutoff, group_score, mean_score, ground_truth, ratio_match, ransac_verify, good_match, validate_top,
        result_names, match_page_rows, match_pages, bow_lines, result_lines,
    )
}

def _candidates(cutoff: int) -> str:
    return TOKENS + f""",
cd AS (SELECT query_id, image_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, image_id DESC) AS rn FROM
  (SELECT q.image_id AS query_id, d.image_id, count(*) AS shared FROM t q JOIN t d USING (word) WHERE q.image_id % 100 = 0 GROUP BY ALL)) WHERE rn <= {cutoff})"""


_MARKED = SCORED + """,
m AS (SELECT query_id, image_id, rank, score, CASE WHEN rank > 3 THEN 0 WHEN round(score, 6) < -1.5 THEN 1 ELSE -1 END AS mark, lpad(CAST(image_id AS VARCHAR), 5, '0') || '.jpg' AS name FROM r)"""
_POSTED = "SELECT word, image_id, round(value, 6) AS weight FROM tb"
_MATCHES = """dd AS (SELECT q.image_id AS query_id, i.image_id, q.kp_id AS kp_q, i.kp_id AS kp_t, sum((q.x - i.x) * (q.x - i.x)) AS sq
  FROM e q JOIN e i ON q.image_id // 4 = i.image_id // 4 AND q.image_id <> i.image_id AND q.dim = i.dim GROUP BY ALL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, image_id, kp_q ORDER BY sq, kp_t) AS rn, lead(sq) OVER (PARTITION BY query_id, image_id, kp_q ORDER BY sq, kp_t) AS nx FROM dd),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, image_id, kp_t ORDER BY sq, kp_q) AS rn, lead(sq) OVER (PARTITION BY query_id, image_id, kp_t ORDER BY sq, kp_q) AS nx FROM dd)"""

CELLS = " || ' ' || ".join(f"printf('%.4f', coalesce(max(CASE WHEN word_id = {k} THEN value END), 0.0::DOUBLE))" for k in range(10))

ORACLES = {
    "flagship": f"WITH {SCORED} SELECT query_id, image_id, round(score, 6) AS score, rank FROM r",
    "idf_flat": f"WITH {TOKENS} SELECT word, round(weight, 6) AS idf FROM tw",
    "stop_words": f"WITH {TREE} SELECT node_id FROM nw WHERE weight <= 0",
    "bow_documents": f"WITH {TEXT_BOW} SELECT image_id, word, round(value, 6) AS value FROM tb",
    "postings_build": f"WITH {TEXT_BOW} {_POSTED}",
    "postings_add": f"WITH {TEXT_BOW} {_POSTED}",
    "postings_remove": f"WITH {TEXT_BOW} {_POSTED} WHERE image_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "index_entries": f"WITH {TEXT_BOW} SELECT count(DISTINCT image_id) AS entries FROM tb",
    "search_documents": f"""WITH {TEXT_BOW}, sc AS (SELECT q.image_id AS query_id, d.image_id, sum(abs(q.value - d.value) - abs(q.value) - abs(d.value)) AS score FROM tb q JOIN tb d USING (word) WHERE q.image_id % 100 = 0 GROUP BY ALL)
SELECT query_id, image_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), image_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 10""",
    "l1_similarity": f"WITH {SCORED} SELECT query_id, image_id, round(score * -0.5, 6) AS score FROM sc",
    "l1_distance": f"WITH {SCORED} SELECT query_id, image_id, round(2 + score, 6) AS distance FROM sc",
    "candidate_cutoff": f"WITH {_candidates(64)} SELECT query_id, image_id, shared FROM cd",
    "search_min_hist": f"""WITH {_candidates(4096)}, norm AS (SELECT image_id, sum(n * weight) AS s FROM t JOIN tw USING (word) GROUP BY image_id),
sc AS (SELECT cd.query_id, cd.image_id, coalesce(sum(least(q.n / nullif(a.s, 0), d.n / nullif(b.s, 0)) * weight), 0) AS score FROM cd JOIN t q ON q.image_id = cd.query_id JOIN t d ON d.image_id = cd.image_id AND d.word = q.word
  JOIN tw ON tw.word = q.word JOIN norm a ON a.image_id = cd.query_id JOIN norm b ON b.image_id = cd.image_id GROUP BY ALL)
SELECT query_id, image_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, image_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 10""",
    "cosine_sim": f"""WITH {TOKENS}, norm AS (SELECT image_id, sqrt(sum(n * weight * n * weight)) AS s FROM t JOIN tw USING (word) GROUP BY image_id),
dt AS (SELECT q.image_id AS query_id, d.image_id, sum(q.n * d.n * weight * weight) AS dot FROM t q JOIN t d USING (word) JOIN tw USING (word) WHERE q.image_id % 100 = 0 GROUP BY ALL),
sc AS (SELECT dt.query_id, dt.image_id, coalesce(dot / nullif(a.s * b.s, 0), 0) AS score FROM dt JOIN norm a ON a.image_id = dt.query_id JOIN norm b ON b.image_id = dt.image_id)
SELECT query_id, image_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, image_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 10""",
    "search_node_l2": f"""WITH {TREE}, v AS (SELECT image_id, node_id, n * weight AS value FROM nc JOIN nw USING (node_id) WHERE weight > 0),
u AS (SELECT image_id, node_id, value / sqrt(sum(value * value) OVER (PARTITION BY image_id)) AS value FROM v),
sc AS (SELECT q.image_id AS query_id, d.image_id, round(sqrt(greatest(0, 2 - 2 * sum(q.value * d.value))), 9) AS score FROM u q JOIN u d USING (node_id) GROUP BY ALL)
SELECT query_id, image_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, image_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 4""",
    "search_node_cutoff": f"""WITH {TREE}, v AS (SELECT image_id, node_id, n * weight AS value FROM nc JOIN nw USING (node_id) WHERE weight > 0),
u AS (SELECT image_id, node_id, value / sqrt(sum(value * value) OVER (PARTITION BY image_id)) AS value FROM v),
en AS (SELECT q.image_id AS query_id, d.image_id, row_number() OVER (PARTITION BY q.image_id ORDER BY round(q.value, 9) DESC, node_id, d.image_id) AS rn FROM u q JOIN u d USING (node_id) WHERE node_id >= 100),
near AS (SELECT DISTINCT query_id, image_id FROM en WHERE rn <= 25),
sc AS (SELECT near.query_id, near.image_id, round(sqrt(greatest(0, 2 - 2 * sum(q.value * d.value))), 9) AS score FROM near JOIN u q ON q.image_id = near.query_id JOIN u d ON d.image_id = near.image_id AND d.node_id = q.node_id GROUP BY ALL)
SELECT query_id, image_id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, image_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 4""",
    "group_score": f"WITH {SCORED} SELECT query_id, CAST(sum(CASE WHEN rank <= 4 AND query_id // 4 = image_id // 4 THEN 1 ELSE 0 END) AS BIGINT) AS group_score FROM r GROUP BY query_id",
    "mean_score": f"""WITH {SCORED}, g AS (SELECT query_id, sum(CASE WHEN query_id // 4 = image_id // 4 THEN 1 ELSE 0 END) AS s FROM r GROUP BY query_id)
SELECT round(avg(coalesce(s, 0)), 6) AS mean_score FROM (SELECT DISTINCT image_id AS query_id FROM d) LEFT JOIN g USING (query_id)""",
    "ground_truth": f"""WITH {DESC}, i AS (SELECT DISTINCT image_id FROM d)
SELECT lpad(CAST(q.image_id AS VARCHAR), 5, '0') AS query, string_agg(lpad(CAST(r.image_id AS VARCHAR), 5, '0'), ',' ORDER BY r.image_id) AS results FROM i q JOIN i r ON q.image_id // 4 = r.image_id // 4 AND q.image_id <> r.image_id GROUP BY q.image_id""",
    "ratio_match": f"WITH {DESC}, {_MATCHES} SELECT query_id, image_id, kp_q, kp_t FROM r1 WHERE rn = 1 AND sq < 0.64 * nx UNION SELECT query_id, image_id, kp_q, kp_t FROM r2 WHERE rn = 1 AND sq < 0.64 * nx",
    "good_match": """SELECT l_orderkey, l_linenumber, round(i / (8 + 0.3 * m), 6) AS confidence, i >= 16 AND i / (8 + 0.3 * m) > 0.7 AS good
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) * 1.0::DOUBLE AS i, CAST(l_quantity + 5 * l_linenumber AS INTEGER) * 1.0::DOUBLE AS m FROM lineitem)""",
    "validate_top": f"WITH {_MARKED} SELECT query_id, image_id, rank, mark FROM m",
    "result_names": f"WITH {_MARKED} SELECT query_id, coalesce(string_agg(name, ',' ORDER BY rank) FILTER (WHERE mark > 0), '-1') AS names FROM m GROUP BY query_id",
    "match_page_rows": f"""WITH {_MARKED} SELECT query_id // 20 AS page, query_id, '<tr>' || string_agg('<td style="border:3px solid ' || CASE WHEN mark > 0 THEN 'green' WHEN mark < 0 THEN 'red' ELSE 'black' END || '"><img src="' || name || '"/></td>', '' ORDER BY rank) || '</tr>' AS html FROM m GROUP BY query_id""",
    "bow_lines": f"""WITH {BOW} SELECT image_id, string_agg('<' || word_id || ', ' || printf('%.6f', value) || '>', ' ' ORDER BY word_id) AS printed,
{CELLS} AS line FROM b GROUP BY image_id""",
    "result_lines": f"WITH {SCORED} SELECT query_id, string_agg(CAST(image_id AS VARCHAR), ' ' ORDER BY rank) AS line FROM r GROUP BY query_id",
}
