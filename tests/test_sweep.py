"""Sweeps against brute force, in blocks and chunks that are small enough to be cut."""

from collections import Counter

import numpy as np
import pytest

from glyphlake.operators import index, search, sweep
from glyphlake.sources.tables import staged, token_bags

WORDS = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(sweep, "QUERIES", 7)
    monkeypatch.setattr(sweep, "ALONE", 40)
    monkeypatch.setattr(sweep, "RANGES", 5)


def texts(n, seed):
    draw = np.random.default_rng(seed)
    rows = [(int(k), " ".join(draw.choice(WORDS, draw.integers(1, 12)))) for k in draw.permutation(n)]
    return rows + [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, ""), (n + 3, None)]


def bags_of(spark, rows):
    return token_bags(spark.createDataFrame(rows, "doc_id long, text string"))


def counts(rows):
    return {k: Counter(t.split()) for k, t in rows if t}


def brute(rows, scorer, top, cutoff=4096):
    own = counts(rows)
    df = Counter(w for c in own.values() for w in c)
    idf = {w: np.log(len(own) / n) for w, n in df.items()}
    whole = {k: np.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items())) if scorer == "cosine" else sum(n * idf[w] for w, n in c.items()) for k, c in own.items()}
    out = set()
    for q in own:
        if q % 10:
            continue
        near = {d: own[q].keys() & own[d].keys() for d in own if own[q].keys() & own[d].keys()}
        if scorer == "min_hist":
            near = dict(sorted(near.items(), key=lambda x: (-len(x[1]), -x[0]))[:cutoff])
        x = lambda k, w: own[k][w] * idf[w] / whole[k]
        if scorer == "cosine":
            scores = {d: -sum(x(q, w) * x(d, w) for w in ws) for d, ws in near.items()}
        elif scorer == "l1":
            scores = {d: sum(abs(x(q, w) - x(d, w)) - x(q, w) - x(d, w) for w in ws) for d, ws in near.items()}
        else:
            scores = {d: -sum(min(own[q][w] / whole[q], own[d][w] / whole[d]) * idf[w] for w in ws) for d, ws in near.items()}
        best = sorted(scores.items(), key=lambda x: (round(x[1], 9), x[0]))[:top]
        out |= {(q, d, i + 1, round(s if scorer == "l1" else -s, 6) + 0.0) for i, (d, s) in enumerate(best)}
    return out


@pytest.mark.parametrize("scorer", ["l1", "cosine", "min_hist"])
def test_documents_are_searched_whole(spark, small, scorer):
    rows = texts(150, 1)
    found = search.search_bags(bags_of(spark, rows), "image_id % 10 = 0", scorer, 6, 20).collect()
    assert {(r["query_id"], r["image_id"], r["rank"], round(r["score"], 6) + 0.0) for r in found} == brute(rows, scorer, 6, 20)


def test_most_shared_are_cut_at_ties_by_id(spark, small):
    rows = texts(150, 2)
    bags, own, want = bags_of(spark, rows), counts(rows), set()
    for q in (k for k in own if k % 10 == 0):
        shared = sorted(((len(own[q].keys() & own[d].keys()), d) for d in own if own[q].keys() & own[d].keys()), reverse=True)
        want |= {(q, d, n) for n, d in shared[:9]}
    assert {tuple(r) for r in sweep.most_shared(bags.where("image_id % 10 = 0"), bags, 9).collect()} == want


def test_tasks_hand_on_the_best_alone(spark):
    rows = [(k, "common word") for k in range(400)] + [(400, "other")]
    bags = bags_of(spark, rows)
    found = sweep.best(sweep.weighted(sweep.with_sums(bags, sweep.frequencies(bags), 401).where("image_id < 5"), sweep.frequencies(bags), 401, "l1"), sweep.with_sums(bags, sweep.frequencies(bags), 401), "l1", 3)
    assert found.count() <= 5 * 3 * 4  # of 2000 pairs; at most four tasks


def test_sums_are_the_same_whatever_is_shipped(spark):
    bags = bags_of(spark, texts(100, 3) + [(500, "once only twice"), (501, "twice")])
    df, n = sweep.frequencies(bags), bags.count()
    whole = [{r["image_id"]: pytest.approx(r["own"]) for r in sweep.with_sums(bags, df, n, 2, shipped).collect()} for shipped in (0, 5, 1000)]
    assert whole[0].keys() == whole[2].keys() and all(whole[1][k].expected == whole[2][k] and whole[0][k].expected == whole[2][k] for k in whole[2])


def test_texts_of_one_id_are_one_bag(spark):
    bags = bags_of(spark, [(1, "ab cd"), (1, "ab"), (2, "Ab-cd"), (3, None)])
    assert {(r["image_id"], r["word"], r["x"]) for r in sweep.entries(bags).collect()} == {(1, "ab", 2.0), (1, "cd", 1.0), (2, "ab", 1.0), (2, "cd", 1.0)}


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    rows = [(k, w, v) for k in range(60) for w, v in [(k % 3, 0.5), (k % 2 + 5, 0.5)]]
    vectors = staged(spark.createDataFrame(rows, "image_id long, word_id int, value double"), "vectors")
    postings, sizes, plain = index.build_index(vectors), [], sweep.best
    want = {tuple(r) for r in search.search(vectors, postings, "l1", 4).collect()}
    monkeypatch.setattr(sweep, "best", lambda q, d, *a, **k: sizes.append((q.count(), d.count())) or plain(q, d, *a, **k))
    assert {tuple(r) for r in search.search(vectors, postings, "l1", 4, alike=True).collect()} == want and len(want) == 240
    assert sizes == [(6, 6)]
    every = {tuple(r) for r in search.by_class(vectors, postings, search.score_l1).collect()}
    assert every == {tuple(r) for r in search.score_l1(vectors, postings).collect()}


def test_node_search_without_cutoff_reads_whole_lists(spark):
    rows = [(k, 1, 0.6) for k in range(5000)] + [(k, 2 + k % 7, 0.8) for k in range(4999)] + [(4999, 20, 0.8), (6000, 1, 0.6), (6000, 20, 0.8)]
    vectors = staged(spark.createDataFrame(rows, "image_id long, node_id int, value double"), "nodes")
    found = search.search_nodes(vectors.where("image_id = 6000"), vectors, None, 2).orderBy("rank").collect()
    assert [(r["image_id"], r["score"]) for r in found] == [(4999, 0.0), (6000, 0.0)]


def test_node_lists_are_cut_once_for_all_queries(spark):
    rows = [(k, n, 0.7) for k in range(40) for n in (1, 2 + k % 2)]
    vectors = spark.createDataFrame(rows, "image_id long, node_id int, value double")
    near = search.leaf_candidates(vectors, vectors, 45)
    assert {r[0]: r[1] for r in near.groupBy("query_id").count().collect()} == {k: 40 for k in range(40)}
    plan = search.search_nodes(vectors, vectors, 5, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert search.search_nodes(vectors, vectors, 5, 4).count() == 160 and "LeftSemi" not in plan
