"""Hand-computed cases, properties and edge cases of the search engine's operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.functions import scalars, vectors
from glyphlake.operators import bow, cluster, collections, engine, evaluate, extract, imageops, index, registry, report, search, tree, verify
from glyphlake.sources import formats, tables
from glyphlake.sources import images as image_files
from glyphlake.streaming import ingest

VECTOR = "image_id long, word_id int, value double"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def vec(spark, *vs):
    return spark.createDataFrame([(i, i // 2, i % 2, [float(x) for x in v]) for i, v in enumerate(vs)], "vec_id long, image_id long, kp_id int, vec array<double>")


def test_partial_l1(spark):
    q = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5)], VECTOR)
    d = spark.createDataFrame([(1, 2, 0.25), (1, 3, 0.75)], VECTOR)
    assert rows(search.score_l1(q, index.build_index(d)), "query_id", "image_id", "score") == [(0, 1, -0.5)]
    assert rows(search.score_l1_similarity(q, index.build_index(d)), "score") == [(0.25,)]
    assert rows(search.full_l1(q, index.build_index(d)), "distance") == [(1.5,)]


def test_equal_and_disjoint_vectors(spark):
    q = spark.createDataFrame([(0, 1, 0.4), (0, 2, 0.6)], VECTOR)
    d = spark.createDataFrame([(1, 1, 0.4), (1, 2, 0.6), (2, 9, 1.0)], VECTOR)
    assert rows(search.score_l1(q, index.build_index(d)), "image_id", "score") == [(1, -2.0)]


@pytest.mark.parametrize(("weights", "expected"), [({1: 1.0, 2: 1.0, 4: 1.0}, 0.333333), ({1: 0.5, 2: 2.0, 4: 1.0}, 0.666667)])
def test_min_hist(spark, weights, expected):
    q = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0)], VECTOR)
    d = spark.createDataFrame([(1, 2, 3.0), (1, 4, 1.0)], VECTOR)
    idf = spark.createDataFrame(list(weights.items()), "word_id int, idf double")
    assert search.search(q, index.build_index(d), "min_hist", idf=idf).first()["score"] == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(("weights", "expected"), [({1: 1.0, 2: 1.0, 4: 1.0}, 0.424264), ({1: 0.5, 2: 2.0, 4: 1.0}, 0.882258)])
def test_cosine(spark, weights, expected):
    q = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0)], VECTOR)
    d = spark.createDataFrame([(1, 2, 3.0), (1, 4, 1.0)], VECTOR)
    idf = spark.createDataFrame(list(weights.items()), "word_id int, idf double")
    assert search.search(q, index.build_index(d), "cosine", idf=idf).first()["score"] == pytest.approx(expected, abs=1e-6)


def test_search_refuses_what_it_does_not_know(spark):
    empty = spark.createDataFrame([], VECTOR)
    with pytest.raises(ValueError, match="unknown scorer"):
        search.search(empty, index.empty_index(spark), "chi")
    with pytest.raises(ValueError, match="idf"):
        search.search(empty, index.empty_index(spark), "cosine")
    with pytest.raises(NotImplementedError):
        search.bow_search()
    assert search.search(empty, index.empty_index(spark)).count() == 0


def test_ties_go_to_the_lower_image(spark):
    scored = spark.createDataFrame([(0, 7, -1.0), (0, 3, -1.0), (0, 5, -2.0)], "query_id long, image_id long, score double")
    assert [r["image_id"] for r in search.top_n(scored, 2).orderBy("rank").collect()] == [5, 3]
    assert search.top_n(scored, 0).count() == 3


def test_idf_and_stop_words(spark):
    words = spark.createDataFrame([(i, w, 1) for w in range(1, 5) for i in range(w)], "image_id long, word_id int, n long")
    weights = {r["word_id"]: r["weight"] for r in bow.word_weights(words).collect()}
    assert [weights[w] for w in range(1, 5)] == pytest.approx([1.386294, 0.693147, 0.287682, 0], abs=1e-6)
    assert rows(bow.stop_words(bow.word_weights(words)), "word_id") == [(4,)]
    assert bow.transform(words, bow.word_weights(words)).where("word_id = 4").count() == 0
    with pytest.raises(ValueError, match="unknown weighting"):
        bow.word_weights(words, "bm25")


def test_weightings(spark):
    words = spark.createDataFrame([(0, 1, 3), (0, 2, 1)], "image_id long, word_id int, n long")
    weights = spark.createDataFrame([(1, 2.0), (2, 0.0)], "word_id int, weight double")
    assert rows(bow.transform(words, weights, "tf_idf"), "word_id", "value") == [(1, 6.0)]
    assert rows(bow.transform(words, weights, "idf"), "word_id", "value") == [(1, 2.0)]


def test_zero_vectors_stay(spark):
    zero = spark.createDataFrame([(0, 1, 0.0), (1, 1, 3.0), (1, 2, 4.0)], VECTOR)
    assert rows(bow.normalize(zero, "l2"), "image_id", "value") == [(0, 0.0), (1, 0.6), (1, 0.8)]
    assert rows(bow.normalize(zero, "l1").groupBy("image_id").agg(F.sum("value").alias("s")), "s") == [(0.0,), (1.0,)]
    assert vectors.l2_normalize(vec(spark, [0, 0], [3, 4])).orderBy("vec_id").select("vec").collect()[1]["vec"] == [0.6, 0.8]
    with pytest.raises(ValueError, match="unknown norm"):
        bow.normalize(zero, "max")


def test_vector_functions(spark):
    one = vec(spark, [1, 2, 3, 4, 5]).withColumn("other", F.array(F.lit(1.0)))
    assert one.select(vectors.dot(F.col("vec"), F.col("other"))).first()[0] == 0.0
    assert one.select(vectors.reshape(F.col("vec"), 2)).first()[0] == [[1, 2], [3, 4]]
    assert one.select(vectors.reshape(F.col("other"), 2)).first()[0] == []
    assert rows(vectors.dense_to_sparse(vec(spark, [0, 5, 0, 1]), "vec", "vec_id"), "idx", "value") == [(1, 5.0), (3, 1.0)]


@pytest.mark.parametrize(("image_id", "expected"), [(5, "0000/0000/000000005"), (1024, "0000/0001/000001024"), (1049600, "0001/0001/001049600")])
def test_feature_path(spark, image_id, expected):
    df = spark.range(1).select(scalars.feature_path(F.lit(image_id).cast("long"), "b", "akaze", "desc").alias("p"))
    assert df.first()["p"] == f"b/feats/akaze/desc/{expected}.desc"
    assert df.select(formats.image_id_of("p")).first()[0] == image_id


@pytest.mark.parametrize("path", ["x/y.jpg", "x\\y.jpg", "y.jpg"])
def test_file_name(spark, path):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(scalars.file_name(F.col("p")), scalars.base_name(F.col("p"))).first()[:] == ("y.jpg", "y")


@pytest.mark.parametrize(("names", "expected"), [([], "-1"), (["a"], "a"), (["a", "b"], "a,b")])
def test_result_csv(spark, names, expected):
    assert spark.createDataFrame([(names,)], "n array<string>").select(scalars.result_csv(F.col("n"))).first()[0] == expected


def test_lines_of_vectors_and_matches(spark):
    v = spark.createDataFrame([(0, 1, 0.5), (0, 3, 0.25)], VECTOR)
    assert bow.dense_lines(v, 4).first()["line"] == "0.0000 0.5000 0.0000 0.2500"
    assert bow.as_map(v).first()["bow"] == {1: 0.5, 3: 0.25}
    one = v.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("word_id", "value"))).alias("p"))
    assert one.select(scalars.bow_line(F.col("p"))).first()[0] == "<1, 0.500000> <3, 0.250000>"
    assert spark.createDataFrame([([*range(10)],)], "i array<int>").select(scalars.match_line(F.col("i"))).first()[0] == "0 1 2 3 4 5 6 7"


@pytest.mark.parametrize(("inliers", "matches", "conf", "good"), [(20, 40, 1.0, True), (16, 50, 0.6957, False), (15, 15, 1.2, False), (16, 49, 0.7048, True)])
def test_good_match(spark, inliers, matches, conf, good):
    c = verify.confidence(F.lit(inliers), F.lit(matches))
    got = spark.range(1).select(c, verify.is_good(F.lit(inliers), c)).first()
    assert got[0] == pytest.approx(conf, abs=1e-4)
    assert got[1] is good


def test_group_of_four(spark):
    matches = spark.createDataFrame([(7, i, r) for r, i in enumerate([4, 5, 9, 6, 7], 1)], "query_id long, image_id long, rank int")
    scores = evaluate.group_score(matches)
    assert rows(scores, "query_id", "group_score") == [(7, 3)]
    asked = spark.createDataFrame([(7,), (8,)], "query_id long")
    assert evaluate.mean_score(asked, scores).first()[0] == 1.5
    truth = evaluate.ground_truth(spark.range(8).withColumnRenamed("id", "image_id")).where("query = '00006'")
    assert truth.first()["results"] == "00004,00005,00007"


def test_integral_image(spark):
    pixels = spark.createDataFrame([(0, y, x, v) for y, r in enumerate([[1, 2], [3, 4]]) for x, v in enumerate(r)], "image_id long, y int, x int, v int")
    got = {(r["y"], r["x"]): r["s"] for r in imageops.integral_image(pixels).collect()}
    assert [[got[y, x] for x in range(3)] for y in range(3)] == [[0, 0, 0], [0, 1, 3], [0, 4, 10]]


def test_hough_finds_a_row(spark):
    pixels = spark.createDataFrame([(0, y, x, int(y == 3)) for y in range(8) for x in range(8)], "image_id long, y int, x int, v int")
    best = imageops.hough_lines(pixels, 1.0, math.pi / 4, 3).where("rank = 1").first()
    assert (best["rho"], best["votes"]) == (3.0, 8)
    assert best["theta"] == pytest.approx(math.pi / 2)


def test_gray(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 255, 255, 255), (0, 0, 1, 255, 0, 0)], "image_id long, y int, x int, c0 int, c1 int, c2 int")
    assert rows(imageops.to_gray(pixels), "x", "v") == [(0, 255), (1, 76)]
    assert imageops.to_rgb(imageops.to_gray(pixels)).columns == ["image_id", "y", "x", "c0", "c1", "c2"]


@pytest.mark.parametrize(("value", "expected"), [(None, 2.0), (5, 5)])
def test_ranged_argument(value, expected):
    assert registry.Argument("rho", float, 2.0, 1, 100).bind(value) == expected


@pytest.mark.parametrize("value", [0, 101])
def test_out_of_range(value):
    with pytest.raises(registry.ArgumentError):
        registry.Argument("rho", float, 2.0, 1, 100).bind(value)


def test_registry(spark):
    known = registry.standard()
    assert len(known.names()) == 8
    assert known.call("echo") == "json output as requested"
    with pytest.raises(registry.ArgumentError, match="required"):
        known.call("integralImage")
    with pytest.raises(registry.ArgumentTypeError):
        known.call("adduser_emailid", users=spark.createDataFrame([], "email string, user_id long"), emailid=3)
    with pytest.raises(registry.ArgumentError, match="no argument"):
        known.call("echo", extra=1)
    with pytest.raises(KeyError):
        known.get("nothing")
    with pytest.raises(ValueError, match="twice"):
        registry.Algorithm("x", print, (registry.Argument("a", int), registry.Argument("a", int)))
    with pytest.raises(ValueError, match="already"):
        known.register(known.get("echo"))
    assert known.describe(spark).where("algorithm = 'houghLines' and argument = 'threshold'").first()["most"] == "255"
    users, status = known.call("adduser_emailid", users=spark.createDataFrame([], "email string, user_id long"), emailid="a@example.com")
    assert (users.count(), status.first()["status"]) == (1, "added")


def test_small_node_has_a_child_for_each(spark):
    nodes = tree.train_tree(vec(spark, [0, 0], [1, 1], [5, 5]), depth=2, split=4)
    assert nodes.where("parent_id = 0").count() == 3
    assert nodes.where("word_id is not null").count() == 3


def test_tree_properties(spark):
    rng = np.random.default_rng(3)
    desc = vec(spark, *rng.normal(size=(60, 3)).tolist())
    nodes = tree.train_tree(desc, depth=2, split=3, max_iter=5).cache()
    assert nodes.where("word_id is not null").count() <= 9
    found = tree.descend(desc, nodes, levels_up=2)
    assert found.count() == 60
    assert rows(found.select("ancestor").distinct(), "ancestor") == [(0,)]
    leaf_paths = tree.ancestors(nodes, 2)
    counts = tree.node_counts(found.select("image_id", F.col("node_id").alias("leaf")), leaf_paths)
    assert counts.where("node_id = 0").agg(F.sum("n")).first()[0] == 60
    with pytest.raises(ValueError, match="empty"):
        tree.descend(desc, nodes.where("node_id = 0"))


def test_unit_tree(spark):
    desc = vec(spark, [1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9], [0.05, 0.95])
    nodes = tree.train_tree(desc, depth=1, split=2, unit=True)
    for r in nodes.where("parent_id = 0").collect():
        assert np.linalg.norm(r["centroid"]) == pytest.approx(1)


def test_training(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(20, 2)) * 0.1 + c for c in ([0, 0], [10, 0], [0, 10])])
    desc = vec(spark, *points.tolist())
    codebook = cluster.train_codebook(desc, 3, seed=5)
    sizes = sorted(r["count"] for r in cluster.assign(desc, codebook).groupBy("word_id").count().collect())
    assert sizes == [20, 20, 20]
    one = cluster.seed_plus_plus(desc, 3, seed=2)
    first = cluster.inertia(cluster.assign(desc, one)).first()[0]
    assert cluster.inertia(cluster.assign(desc, cluster.lloyd_step(desc, one))).first()[0] <= first + 1e-9
    same = vec(spark, [1, 1], [1, 1], [1, 1])
    assert cluster.seed_plus_plus(same, 3).count() == 1
    with pytest.raises(ValueError, match="no descriptors"):
        cluster.train_codebook(desc.limit(0), 3)


def test_assignment_ties_and_blocks(spark, monkeypatch):
    codebook = spark.createDataFrame([(7, [1.0, 0.0]), (2, [-1.0, 0.0]), (9, [5.0, 5.0])], "word_id int, centroid array<double>")
    desc = vec(spark, [0, 0], [4, 4])
    assert rows(cluster.assign(desc, codebook), "vec_id", "word_id") == [(0, 2), (1, 9)]
    monkeypatch.setattr(cluster, "BLOCK_BYTES", 16)
    assert rows(cluster.assign(desc, codebook), "vec_id", "word_id") == [(0, 2), (1, 9)]
    with pytest.raises(ValueError, match="empty"):
        cluster.assign(desc, codebook.limit(0))


def test_sample_and_cap(spark):
    images = spark.range(100).select(F.col("id").alias("image_id"), F.lit(10).alias("n"))
    assert cluster.sample(images, 7).count() == 7
    assert cluster.sample(images, 700).count() == 100
    assert rows(cluster.feature_cap(images, "n", 25), "image_id") == [(0,), (1,), (2,)]


def test_add_then_remove_restores(spark):
    old = spark.createDataFrame([(1, 10, 0.5)], index.SCHEMA)
    more = spark.createDataFrame([(11, 1, 1.0), (10, 1, 9.0)], VECTOR)
    grown = index.add_images(old, more)
    assert rows(grown, "word_id", "image_id", "weight") == [(1, 10, 0.5), (1, 11, 1.0)]
    back = index.remove_images(grown, spark.createDataFrame([(11,)], "image_id long"))
    assert rows(back, "word_id", "image_id", "weight") == rows(old, "word_id", "image_id", "weight")
    assert index.entries(grown).first()[0] == 2
    assert index.posting_lists(grown).first()["entries"][0]["image_id"] == 10


def test_bucketed_index_is_joined_in_place(spark):
    rows_in = spark.createDataFrame([(w, i, 1.0) for w in range(20) for i in range(5)], index.SCHEMA)
    index.save_bucketed(rows_in, "postings_test", 4)
    assert spark.table("postings_test").count() == 100
    spark.sql("DROP TABLE postings_test")


def test_users_and_images(spark):
    users = spark.createDataFrame([("a@x", 1)], "email string, user_id long")
    more, status = collections.add_users(users, spark.createDataFrame([("a@x",), ("b@x",), ("b@x",), (None,)], "email string"))
    assert rows(status, "email", "status") == [("a@x", "already exists"), ("b@x", "added")]
    assert more.count() == 2
    assert collections.colliding(more).count() == 0
    images = spark.createDataFrame([("a@x", "p", 4)], "email string, path string, image_id long")
    asked = spark.createDataFrame([("a@x", "p"), ("a@x", "q"), ("z@x", "r")], "email string, path string")
    grown, status = collections.add_images(users, images, asked)
    assert rows(status, "email", "path", "image_id") == [("a@x", "p", -2), ("a@x", "q", 5), ("z@x", "r", -1)]
    high = spark.createDataFrame([("a@x", 9)], "email string, image_id long")
    assert rows(collections.add_images(users, images, asked, high)[1].where("path = 'q'"), "image_id") == [(10,)]
    left, removed = collections.remove_images(grown, spark.createDataFrame([("a@x", 4), ("a@x", 99)], "email string, image_id long"))
    assert rows(removed, "image_id", "removed") == [(4, True), (99, False)]
    assert rows(left, "path") == [("q",)]
    kept = collections.delete_users(users, spark.createDataFrame([("a@x",), ("n@x",)], "email string"), images)
    assert rows(kept[1], "email", "status") == [("a@x", "deleted"), ("n@x", "unknown user")]
    assert kept[2].count() == 1
    assert collections.delete_users(users, spark.createDataFrame([("a@x",)], "email string"), images, purge=True)[2].count() == 0
    assert rows(collections.locations(users, spark.createDataFrame([("a@x",), ("n@x",)], "email string")), "location") == [("",), ("users/user_a@x",)]
    ranked = spark.createDataFrame([(0, 4, 1, -1)], "query_id long, image_id long, rank int, mark int")
    assert collections.retrieve(ranked, images).first()["names"] == "-1"
    assert collections.retrieve(ranked, images, topn=1).first()["names"] == "p"


def test_geometry(spark):
    rng = np.random.default_rng(0)
    a = rng.random((40, 2)) * 400
    h = np.array([[1.1, 0.05, 3], [-0.02, 0.95, 8], [1e-4, 2e-5, 1]])
    p = np.hstack([a, np.ones((40, 1))]) @ h.T
    b = p[:, :2] / p[:, 2:]
    b[30:] += 80
    model, mask = verify.ransac(a, b, "h", seed=1)
    assert mask[:30].all()
    assert not mask[30:].any()
    assert model / model[2, 2] == pytest.approx(h, abs=1e-3)
    z = rng.random(40) * 5 + 4
    x = rng.random((40, 2)) * 4 - 2
    left = x / z[:, None] * 500
    right = (x + [1.0, 0.2]) / (z + 0.3)[:, None] * 500
    right[35:] = rng.random((5, 2)) * 400
    _, mask = verify.ransac(left, right, "f", seed=1)
    assert mask[:35].sum() >= 33
    assert verify.ransac(a[:8], b[:8])[0] is None
    with pytest.raises(ValueError, match="unknown model"):
        verify.ransac(a, b, "affine")


def test_verify_needs_nine(spark):
    points = spark.createDataFrame([(i, k, float(k * k % 17), float(k)) for i in (0, 1) for k in range(5)], "image_id long, kp_id int, x double, y double")
    matches = spark.createDataFrame([(0, 1, k, k) for k in range(5)], "query_id long, image_id long, kp_q int, kp_t int")
    got = verify.verify(matches, points).first()
    assert (got["num_inliers"], got["confidence"], got["good"]) == (0, 0.0, False)


def test_pages(spark):
    marked = spark.createDataFrame([(0, 4, 1, 1), (21, 5, 1, -1)], "query_id long, image_id long, rank int, mark int")
    names = spark.createDataFrame([(4, "a.jpg"), (5, "b.jpg")], "image_id long, name string")
    made = {r["page"]: r["html"] for r in report.pages(report.match_rows(marked, names)).collect()}
    assert "green" in made[0] and "1.html" in made[0] and "previous" not in made[0]
    assert "red" in made[1] and "0.html" in made[1] and "next" not in made[1]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**63), st.text(max_size=20))))
def test_collection_round_trip(pairs):
    pairs = [(i, p.encode("utf-8", "ignore").decode()) for i, p in pairs]
    assert formats.unpack_collection(formats.pack_collection(pairs)) == pairs


@pytest.mark.parametrize("kind", [np.uint8, np.float32, np.float64])
def test_matrix_round_trip(kind):
    x = np.arange(12, dtype=kind).reshape(3, 4)
    assert (formats.unpack_matrix(formats.pack_matrix(x)) == x).all()
    with pytest.raises(ValueError, match="empty"):
        formats.unpack_matrix(formats.pack_matrix(x[:0]))


def test_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "000000007.mat").write_bytes(formats.pack_matrix(np.ones((2, 3), np.float32)))
    (tmp_path / "a" / "b" / "empty.mat").write_bytes(formats.pack_matrix(np.ones((0, 3), np.float32)))
    (tmp_path / "a" / "x.sp").write_bytes(formats.pack_sparse([(3, 0.5), (9, 1.5)]))
    (tmp_path / "a" / "x.dv").write_bytes(formats.pack_dense([1.0, 2.0]))
    (tmp_path / "a" / "x.db").write_bytes(formats.pack_collection([(4, "images/q.jpg")]))
    idf, lists = formats.unpack_flat_index(formats.pack_flat_index([0.5, 1.0], [np.array([1, 2]), np.array([], int)]))
    assert (idf.tolist(), [x.tolist() for x in lists]) == ([0.5, 1.0], [[1, 2], []])
    at = str(tmp_path)
    assert formats.list_files(spark, at, ".mat").count() == 2
    assert formats.list_files(spark, f"{at}/a", ".mat", recursive=False).count() == 1
    assert formats.list_folders(spark, at).count() == 2
    assert formats.list_updated(spark, at, "2000-01-01T00:00:00").count() == 5
    assert rows(formats.read_matrices(spark, at, "*.mat"), "kp_id") == [(0,), (1,)]
    assert rows(formats.read_sparse(spark, at, "*.sp"), "word_id", "value") == [(3, 0.5), (9, 1.5)]
    assert rows(formats.read_dense(spark, at, "*.dv"), "node_id", "value") == [(0, 1.0), (1, 2.0)]
    assert rows(formats.read_collection(spark, at, "*.db"), "image_id", "image_path") == [(4, "images/q.jpg")]


def test_open_or_build(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.open_or_build(spark, f"{tmp_path}/t", build).count() == 3
    assert len(calls) == 1


def test_empty_collections(spark):
    assert tables.next_id(spark.createDataFrame([], "image_id long")).first()[0] == 0
    assert tables.number_images(spark.createDataFrame([], "path string")).count() == 0
    assert tables.descriptors(spark.createDataFrame([(0, [])], "vec_id long, embedding array<float>")).count() == 0


def test_extraction_says_what_it_needs():
    pytest.importorskip("pyspark")
    try:
        import cv2  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="OpenCV"):
            extract._detector("akaze")
    with pytest.raises(ValueError, match="unknown feature"):
        extract.extract(None, "orb")


def test_stream_appends_postings(spark, tmp_path):
    source = spark.createDataFrame([(1, 5, 2), (2, 5, 1), (2, 6, 1)], "image_id long, word_id int, n long")
    source.write.parquet(f"{tmp_path}/in")
    weights = spark.createDataFrame([(5, 1.0), (6, 2.0)], "word_id int, weight double")
    stream = ingest.events_stream(spark, f"{tmp_path}/in", "image_id long, word_id int, n long")
    ingest.maintain(stream, weights, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r["image_id"], r["word_id"], round(r["weight"], 4)) for r in got.collect()) == [(1, 5, 1.0), (2, 5, 0.3333), (2, 6, 0.6667)]


def test_only_local_masters_stage_without_a_shared_folder():
    assert tables.shared_folder("hdfs://x/y/", "yarn", "a") == "hdfs://x/y"
    assert tables.shared_folder(None, "local[4]", "app").endswith("glyphlake-app")
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            tables.shared_folder(None, master, "app")


def test_staged_tables_go(spark):
    import os

    df = tables.staged(spark.range(3), "three")
    folder = os.path.dirname(df.staged_at.removeprefix("file://"))
    assert df.count() == 3 and os.path.isdir(folder)
    tables.unstage(df)
    assert not os.path.exists(folder)


def test_entries_of_the_greatest_leaves_come_first(spark):
    """With few entries, images of the leaf that weighs most are found, whatever their ids."""
    nodes = "image_id long, node_id int, value double"
    q = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.4)], nodes)
    d = spark.createDataFrame([(i, 2, 1.0) for i in range(1, 50)] + [(i, 1, 1.0) for i in range(100, 103)], nodes)
    assert rows(search.leaf_candidates(q, d, 5), "image_id") == [(1,), (2,), (100,), (101,), (102,)]
    assert rows(search.leaf_candidates(q, d, 2), "image_id") == [(100,), (101,)]
    assert len(rows(search.leaf_candidates(q, d, 4096), "image_id")) == 52
    assert {r[0] for r in rows(search.search_nodes(q, d, 3, 64), "image_id")} == {100, 101, 102}


def test_stored_forms_are_checked(spark, tmp_path):
    nodes = spark.createDataFrame([(0, None, 0, None, None, None), (1, 0, 1, [0.1, 1 / 3], 0.25, 0), (2, 0, 1, [1e-9, 2.0], 0.5, 1)], engine.TREE)
    engine.save_tree(nodes, f"file://{tmp_path}/tree")
    assert rows(engine.load_tree(spark, f"file://{tmp_path}/tree").where("level = 1"), *nodes.columns) == rows(nodes.where("level = 1"), *nodes.columns)
    postings = spark.createDataFrame([(1, 7, 0.5), (0, 7, 1 / 3)], engine.POSTINGS)
    engine.save_index(postings, f"file://{tmp_path}/index")
    assert rows(engine.load_index(spark, f"file://{tmp_path}/index"), *postings.columns) == rows(postings, *postings.columns)
    with pytest.raises(ValueError):
        engine.load_tree(spark, f"file://{tmp_path}/index")
    with pytest.raises(ValueError):
        engine.load_index(spark, f"file://{tmp_path}/tree")
    engine.save_tree(nodes.withColumn("word_id", F.lit(None).cast("int")), f"file://{tmp_path}/bare")
    with pytest.raises(ValueError):
        engine.load_tree(spark, f"file://{tmp_path}/bare")
    users = spark.createDataFrame([("a@x", 2**62), ("b@x", -5)], "email string, user_id long")
    engine.save_users(users, f"file://{tmp_path}/users")
    assert rows(engine.load_users(spark, f"file://{tmp_path}/users"), "email", "user_id") == [("a@x", 2**62), ("b@x", -5)]


def test_a_users_image_reaches_the_index(spark):
    users = spark.createDataFrame([("a@x", 1), ("b@x", 2)], "email string, user_id long")
    images = spark.createDataFrame([("a@x", "p0", 0)], "email string, path string, image_id long")
    postings = spark.createDataFrame([("a@x", 0, 5, 1.0)], "email string, image_id long, word_id int, weight double")
    asked = spark.createDataFrame([("a@x", "p1"), ("b@x", "p1"), ("a@x", "p0"), ("c@x", "p1")], "email string, path string")
    words = spark.createDataFrame([("p1", 5), ("p1", 5), ("p1", 6), ("p1", 7), ("p0", 6)], "path string, word_id int")
    weights = spark.createDataFrame([(5, 1.0), (6, 2.0), (7, 0.0)], "word_id int, weight double")
    left, index_of, status = engine.add_user_images(users, images, asked, postings, words, weights)
    assert rows(status, "email", "path", "image_id") == [("a@x", "p0", -2), ("a@x", "p1", 1), ("b@x", "p1", 0), ("c@x", "p1", -1)]
    assert rows(left, "email", "image_id") == [("a@x", 0), ("a@x", 1), ("b@x", 0)]
    assert rows(index_of, "email", "image_id", "word_id", "weight") == [("a@x", 0, 5, 1.0), ("a@x", 1, 5, 0.5), ("a@x", 1, 6, 0.5), ("b@x", 0, 5, 0.5), ("b@x", 0, 6, 0.5)]


def test_retrieval_from_descriptors_to_names(spark):
    """Two views of one scene and a stranger: the search ranks, points match, the geometry verifies, names come out."""
    rng = np.random.default_rng(2)
    scene, other = rng.normal(size=(30, 8)), rng.normal(size=(30, 8))
    depth, at = rng.uniform(2, 6, 30), rng.uniform(-1, 1, (30, 2))
    one = at * 400 + 400
    two = (at * depth[:, None] + [0.5, 0.1]) / (depth[:, None] + 0.3) * 400 + 400
    desc = [(i, k, v.tolist()) for i, vs in ((0, scene), (1, scene + 1e-3), (2, other)) for k, v in enumerate(vs)]
    points = [(i, k, *map(float, p)) for i, ps in ((0, one), (1, two), (2, one)) for k, p in enumerate(ps)]
    desc = spark.createDataFrame(desc, "image_id long, kp_id int, vec array<double>")
    points = spark.createDataFrame(points, "image_id long, kp_id int, x double, y double")
    vectors = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.1), (2, 3, 0.9)], VECTOR)
    names = spark.createDataFrame([(i, f"x/{i}.jpg") for i in range(3)], "image_id long, path string")
    got = dict(rows(engine.retrieve(vectors, index.build_index(vectors), desc, points, names), "query_id", "names"))
    assert got[0].split(",") == ["0.jpg", "1.jpg"] and got[2] == "2.jpg"
    first = dict(rows(engine.retrieve(vectors, index.build_index(vectors), desc, points, names, topn=3), "query_id", "names"))
    assert first[0] == "0.jpg,1.jpg,2.jpg"


def test_trials_end_when_sure():
    rng = np.random.default_rng(1)
    a = rng.uniform(0, 600, (40, 2))
    h = np.array([[0.9, 0.1, 12], [-0.05, 1.1, -7], [1e-4, 2e-5, 1]])
    b = np.hstack([a, np.ones((40, 1))]) @ h.T
    b = b[:, :2] / b[:, 2:]
    b[:10] += 80
    model, mask = verify.ransac(a, b, "h")
    assert mask.tolist() == [False] * 10 + [True] * 30
    assert np.allclose(model / model[2, 2], h, atol=1e-3)


def png(rows, colour, filters, depth=8, palette=None):
    """A PNG file of rows of bytes, each row under its filter."""
    import struct
    import zlib

    step, above, out = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour], [0] * len(rows[0]), b""
    for row, kind in zip(rows, filters, strict=True):
        line = []
        for x, v in enumerate(row):
            left, up, corner = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda q: (abs(p - q), (left, up, corner).index(q)))
            line.append((v - {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]) % 256)
        out += bytes([kind, *line])
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    width = len(rows[0]) // step if depth == 8 else len(rows[0]) * 8 // depth
    head = struct.pack(">IIBBBBB", width, len(rows), depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_png_filters(colour):
    rng = np.random.default_rng(colour)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    want = rng.integers(0, 256, (10, 7, channels))
    found = image_files.decode(png(want.reshape(10, -1).tolist(), colour, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0]))
    assert found.tolist() == want[:, :, : 3 if channels > 2 else 1].tolist()


def test_pixels_of_files(spark):
    import struct

    grey = [[0, 10, 20], [30, 40, 50]]
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 2, 1, 24, 0, 0, 0, 0, 0, 0) + bytes([3, 2, 1, 0, 6, 5, 4, 0])
    files = [(1, png(grey, 0, [0, 4])), (2, b"P5 # made by hand\n3 2\n255\n" + bytes(sum(grey, []))), (3, bmp), (4, b"no image"), (5, None), (6, png([[0b10110000]], 0, [0], depth=1)), (7, png([[1, 0]], 3, [0], palette=bytes([9, 8, 7, 6, 5, 4])))]
    got = image_files.pixels(spark.createDataFrame(files, "image_id long, content binary"))
    by = {}
    for r in got.collect():
        by.setdefault(r["image_id"], {})[r["y"], r["x"]] = (r["c0"], r["c1"], r["c2"])
    assert by[1] == by[2] == {(y, x): (v, v, v) for y, line in enumerate(grey) for x, v in enumerate(line)}
    assert by[3] == {(0, 0): (4, 5, 6), (1, 0): (1, 2, 3)}
    assert by[7] == {(0, 0): (6, 5, 4), (0, 1): (9, 8, 7)}
    assert [by[6][0, x][0] for x in range(8)] == [255, 0, 255, 255, 0, 0, 0, 0]
    assert set(by) == {1, 2, 3, 6, 7}
    summed = imageops.integral_image(imageops.to_gray(got.where("image_id = 1")))
    assert summed.agg(F.max("s")).first()[0] == pytest.approx(150)


def test_files_are_written_and_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}"
    desc = spark.createDataFrame([("f/1.desc", 1, [3.0, 4.0]), ("f/1.desc", 0, [1.0, 2.5]), ("f/2.desc", 0, [9.0, 9.0])], "name string, kp_id int, vec array<float>")
    assert rows(formats.write_files(formats.matrix_files(desc), folder), "name") == [("f/1.desc",), ("f/2.desc",)]
    back = formats.read_matrices(spark, folder, "*.desc")
    assert rows(back.withColumn("name", F.regexp_extract("path", "(f/.*)$", 1)), "name", "kp_id", "vec") == rows(desc, "name", "kp_id", "vec")
    vectors = spark.createDataFrame([("v.bow", 5, 0.5), ("v.bow", 2, 0.25)], "name string, word_id long, value float")
    formats.write_files(formats.sparse_files(vectors), folder)
    assert rows(formats.read_sparse(spark, folder, "*.bow"), "word_id", "value") == [(2, 0.25), (5, 0.5)]
    images = spark.createDataFrame([("c.db", 2, "b/é.jpg"), ("c.db", 1, "a.jpg")], "name string, image_id long, image_path string")
    formats.write_files(formats.collection_files(images), folder)
    assert rows(formats.read_collection(spark, folder, "*.db"), "image_id", "image_path") == [(1, "a.jpg"), (2, "b/é.jpg")]
    lists = spark.createDataFrame([("i.idx", 1, 0.5, [7, 8]), ("i.idx", 0, 1.5, [])], "name string, word_id int, idf float, image_ids array<long>")
    formats.write_files(formats.flat_index_files(lists), folder)
    assert rows(formats.read_flat_index(spark, folder, "*.idx"), "word_id", "idf", "image_ids") == [(0, 1.5, []), (1, 0.5, [7, 8])]
