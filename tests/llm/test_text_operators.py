"""Language, toxicity, quality, rules and personal data: brute force on small tables, accuracy on held-out rows, edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphlake.llm import language, pii, quality, queries, rules, toxicity
from glyphlake.llm.common import fold_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra int"
ODD = [
    (1, None, "en", "s", 0, 1),
    (2, "", None, None, 0, 1),
    (3, " \t\n\x0b\x0c\r ", "en", "s", 7, 1),
    (4, "a", "en", "s", 1, 1),
    (None, "no id here", "en", "s", 10, 1),
    (5, "same same", "en", "s", 9, 1),
    (5, "same same", "en", "s", 9, 1),
    (6, "x" * 50_000 + " " + "word " * 20_000, "de", "s", 150_001, 1),
    (7, "12345 67", "fr", "t", 8, 1),
    (8, "😀 ünïcödé — text", "fr", "t", 16, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Language


def test_language_held_out(spark, sf_dir, docs):
    got = by_id(queries.op2_language_id(spark, sf_dir))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(truth)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.9


def test_language_is_naive_bayes(spark):
    """Counts and posteriors of a tiny model by hand."""
    rows = spark.createDataFrame([(1, "aab", "x"), (2, "bbb", "y"), (3, None, "x"), (4, "zz", None)], "doc_id long, text string, lang string")
    langs, log_prob = language.fit(rows, F.lit(True))
    assert langs == ["x", "y"]
    seen = {}
    for lang, text in (("x", "aab"), ("y", "bbb")):
        codes, offsets = language._codes([text])
        seen[lang] = np.concatenate([h[s[0] : e[0]] for h, (s, e) in language._buckets(codes, offsets)])
    for k, lang in enumerate(langs):
        counts = np.bincount(seen[lang], minlength=1 << language.BITS) + 0.1
        assert log_prob[:, k] == pytest.approx(np.log(counts / counts.sum()), abs=1e-4)
    codes, offsets = language._codes(["ab"])
    grams = np.concatenate([h[s[0] : e[0]] for h, (s, e) in language._buckets(codes, offsets)])
    logits = log_prob[grams].sum(axis=0) / np.sqrt(len(grams))
    p = np.exp(logits - logits.max())
    one = language.predict(spark.createDataFrame([(9, "ab")], "doc_id long, text string"), langs, log_prob, "doc_id").first()
    assert one["lang_pred"] == langs[int(p.argmax())]
    assert one["score"] == pytest.approx(p.max() / p.sum(), abs=1e-6)


def test_language_edges(spark, odd):
    model = language.fit(odd, F.lit(True))
    got = language.predict(odd, *model, "doc_id", "extra").collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 7):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[4]["lang_pred"] != "und"
    assert language.predict(odd.limit(0), *model, "doc_id").count() == 0
    none = language.fit(odd.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(odd, *none, "doc_id").collect()} == {"und"}


def test_pieces_of_a_text_have_the_grams_of_the_whole(monkeypatch):
    rng = np.random.default_rng(7)
    make = lambda letters, n: "".join(rng.choice(list(letters + " "), n))
    rows = [(i, make("abcde" if i % 2 else "defgh", int(rng.integers(0, 3000))), "xy"[i % 2]) for i in range(30)] + [(40, "İ" * 50 + "Σ" * 40, "x"), (41, None, "y")]
    monkeypatch.setattr(language, "PIECE", 7)
    texts = [r[1] or "" for r in rows]
    for n_at, n in enumerate(language.LENGTHS):
        found = [[] for _ in texts]
        for owners, parts, own in language._pieces(texts):
            codes, offsets = language._codes(parts)
            h, (start, end) = list(language._buckets(codes, offsets))[n_at]
            for k, i in enumerate(owners):
                found[i] += h[start[k] : min(end[k], start[k] + own[k])].tolist()
        for i, t in enumerate(texts):
            codes, offsets = language._codes([t])
            h, (start, end) = list(language._buckets(codes, offsets))[n_at]
            assert found[i] == h[start[0] : end[0]].tolist(), (n, i)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=6), min_size=1, max_size=5))
def test_grams_stay_in_their_text(texts):
    codes, offsets = language._codes(texts)
    for n, (h, (start, end)) in zip(language.LENGTHS, language._buckets(codes, offsets), strict=True):
        for i, t in enumerate(texts):
            one, o = language._codes([t])
            alone = dict(zip(language.LENGTHS, language._buckets(one, o), strict=True))[n]
            assert h[start[i] : end[i]].tolist() == alone[0][alone[1][0][0] : alone[1][1][0]].tolist()


# Toxicity


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choice(vocabulary, 60).tolist()
        bad = i % 3 == 0
        if bad:
            for k in rng.choice(60, 4, replace=False):
                words[k] = "grumbolt" if k % 2 else "snarfen"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 4 != 2)
    got = by_id(toxicity.score(docs, model, "doc_id"))
    held = [i for i in range(600) if i % 4 == 2]
    assert all((got[i]["score"] >= 0.3) == (i % 3 == 0) for i in held)
    assert model.lexicon["grumbolt" if "grumbolt" in model.lexicon else next(w for w in model.lexicon if w.startswith("grum"))][0] == 0


def test_toxicity_of_tables(spark, sf_dir, docs):
    got = by_id(queries.op3_toxicity(spark, sf_dir))
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd, none, F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(odd, None, "doc_id").collect()} == {0.0}
    assert toxicity.text_features("", {}) == [0.0] * len(toxicity.NAMES)
    lexicon = {"idiot": (0, 3.0), "foul*": (0, 2.0), "": frozenset(["fou"])}
    named = lambda t: dict(zip(toxicity.NAMES, toxicity.text_features(t, lexicon), strict=True))
    assert named("You idiot foulest")["strong_distinct"] == 2
    assert named("you idiot")["near_second"] == 0.5
    assert named("1d1ot and i.d.i.o.t")["hidden_strong"] == 2
    assert named("foul")["strong"] == 0


def test_trees_by_brute_force():
    """The first tree's every split is the best of all, and scores are the sums of the leaves that a row falls into."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0.8)).astype(float)
    weight = np.ones(300)
    edges, trees, base = toxicity.grow(x, y, weight)
    b = np.stack([[int(np.sum(edges[k] <= v)) for v in x[:, k]] for k in range(3)], axis=1)
    p = 1 / (1 + np.exp(-base))
    g, h = y - p, np.full(300, p * (1 - p))

    def score_of(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + 1)

    def best(rows):
        gains = [0.0]
        for k in range(3):
            for c in range(toxicity.BINS):
                left, right = rows[b[rows, k] <= c], rows[b[rows, k] > c]
                if h[left].sum() >= 2 and h[right].sum() >= 2:
                    gains.append(score_of(left) + score_of(right) - score_of(rows))
        return max(gains)

    feature, cut, leaves = trees[0]
    todo = [(0, np.arange(300))]
    while todo:
        node, rows = todo.pop()
        if node >= len(feature):
            leaf = node - len(feature)
            assert leaves[leaf] == pytest.approx(toxicity.SHRINK * g[rows].sum() / (h[rows].sum() + 1))
            continue
        left, right = rows[b[rows, feature[node]] <= cut[node]], rows[b[rows, feature[node]] > cut[node]]
        gain = score_of(left) + score_of(right) - score_of(rows) if len(left) and len(right) else 0.0
        assert gain == pytest.approx(best(rows), abs=1e-6)
        todo += [(2 * node + 1, left), (2 * node + 2, right)]
    scores = toxicity.raw_score(x, edges, trees, base)
    for i in range(0, 300, 17):
        total = base
        for feature, cut, leaves in trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(b[i, feature[node]] > cut[node])
            total += leaves[node - len(feature)]
        assert scores[i] == pytest.approx(total)
    assert ((scores > 0) == (y == 1)).mean() > 0.95


def test_features_by_hand():
    lexicon = {"grumbolt": (0, 3.0), "snarf*": (0, 2.0), "meh": (1, 1.2), "bah": (2, 0.5), "": frozenset(["sna"])}
    text = "YOU Grumbolt, snarfen meh! bah gr0mbolt w1 x.y"
    got = dict(zip(toxicity.NAMES, toxicity.text_features(text, lexicon), strict=True))
    found = ["you", "grumbolt", "snarfen", "meh", "bah", "gr", "mbolt", "w", "x", "y"]
    m = len(found)
    letters = sum(map(len, found))
    want = {"strong": 200 / m, "strong_distinct": 2, "medium": 100 / m, "weak": 100 / m, "near_second": 0.5, "second": 100 / m}
    want |= {"capitals": 4 / letters, "punctuation": (len(text) - letters - text.count(" ")) / len(text), "log_words": np.log1p(m), "mean_weight": (3 + 2 + 1.2 + 0.5) / m}
    for name, value in want.items():
        assert got[name] == pytest.approx(value), name
    assert got["hidden_strong"] == 0 and dict(zip(toxicity.NAMES, toxicity.text_features("grumb0lt", lexicon), strict=True))["hidden_strong"] == 1


def test_isotonic_is_monotone_and_exact():
    x, y = np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])
    knots = toxicity.isotonic(x, y, np.ones(4))
    assert np.interp([1, 2, 3, 4], *knots).tolist() == [0, 0.5, 0.5, 1]


# Quality


def test_quality_held_out(spark, sf_dir, docs):
    got = by_id(queries.op9_quality(spark, sf_dir))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.85


def test_quality_blocks_equal_single_texts():
    rng = np.random.default_rng(0)
    texts = ["", "one", "two words", "The The The", "éü x", "a" * 9, " lead and trail ", "x\ny\tz"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    weight = rng.random(quality.BUCKETS)
    for (buckets, bounds), kind in zip(quality.features(data, offsets), range(9), strict=False):
        for i, t in enumerate(texts):
            own = np.frombuffer(t.encode(), np.uint8)
            alone = list(quality.features(own, np.array([0, len(own)])))[kind]
            assert buckets[bounds[i] : bounds[i + 1]].tolist() == alone[0].tolist(), (kind, t)
    assert weight.shape == (quality.BUCKETS,)


def test_quality_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(odd, none, F.lit(True))
    got = quality.score(odd, model, *odd.columns, name="q").collect()
    assert len(got) == len(ODD)
    assert {r["q"] for r in got} == {0.5}
    assert got[0].asDict().keys() == {*odd.columns, "q"}
    assert quality.score(odd.limit(0), model, "doc_id").count() == 0


def test_a_step_of_training_by_hand():
    """One pass over three documents, number by number."""
    xs = [(np.array([1, 5, 9], np.int32), np.array([0.5, 0.25, 0.25], np.float32)), (np.array([2, 5], np.int32), np.array([0.5, 0.5], np.float32)), (np.array([], np.int32), np.array([], np.float32))]
    ys, dim, rate, seed = np.array([1, 0, 1]), 2, 0.5, 3
    weight, bias = quality.train(xs, ys, dim, 1, rate, seed)
    rng = np.random.default_rng(seed)
    first = ((rng.random((quality.BUCKETS, dim)) - 0.5) / dim).astype(np.float32)
    vectors = {b: [float(x) for x in first[b]] for ids, _ in xs for b in ids.tolist()}
    layer, biases = [[0.0, 0.0] for _ in range(dim)], [0.0, 0.0]
    cost = {0: 0.5 / (1 / 3), 1: 0.5 / (2 / 3)}
    for step, i in enumerate(rng.permutation(3).tolist()):
        ids, parts = xs[i][0].tolist(), xs[i][1].tolist()
        lr = rate * (1 - step / 3) * cost[int(ys[i])]
        hidden = [sum(p * vectors[b][d] for b, p in zip(ids, parts, strict=True)) for d in range(dim)]
        z = [sum(hidden[d] * layer[d][c] for d in range(dim)) + biases[c] for c in (0, 1)]
        total = sum(np.exp(x) for x in z)
        grad = [np.exp(z[c]) / total - (ys[i] == c) for c in (0, 1)]
        back = [sum(layer[d][c] * grad[c] for c in (0, 1)) for d in range(dim)]
        for b, p in zip(ids, parts, strict=True):
            vectors[b] = [v - lr * p**0.5 * x for v, x in zip(vectors[b], back, strict=True)]
        layer = [[layer[d][c] - lr * hidden[d] * grad[c] for c in (0, 1)] for d in range(dim)]
        biases = [biases[c] - lr * 0.1 * grad[c] for c in (0, 1)]
    for b, v in vectors.items():
        assert weight[b] == pytest.approx(sum(v[d] * (layer[d][1] - layer[d][0]) for d in range(dim)), abs=1e-5)
    assert bias == pytest.approx(biases[1] - biases[0], abs=1e-5)


def test_scores_are_the_averages_of_features(spark):
    rng = np.random.default_rng(9)
    model = quality.Model(rng.normal(size=quality.BUCKETS).astype(np.float32), 0.3)
    texts = ["one two two three", "", "aé b", "x" * 40, None]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, "doc_id").collect()}
    for i, t in enumerate(texts):
        ids, parts = quality.sparse(np.frombuffer((t or "").encode(), np.uint8))
        odds = sum(float(model.weight[b]) * float(p) for b, p in zip(ids, parts, strict=True)) + 0.3
        assert got[i] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-5)


def test_sample_has_one_row_for_an_id(spark):
    from glyphlake.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "two"), (2, "two"), (3, None), (4, "four")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 5), (None, 1)], "doc_id long, y int")
    got = labelled_sample(docs, labels, "y", F.lit(True), 100, "s").collect()
    assert sorted((r["doc_id"], r["y"]) for r in got) == [(1, 1), (2, 0)]


def test_said_twice_is_one_feature():
    pair = lambda t: list(quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)])))[1][0].tolist()
    assert pair(b"so so") == pair(b"ab ab")
    assert pair(b"so ab") != pair(b"ab so")


# Rules


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_by_brute_force(spark, sf_dir, docs):
    got = by_id(queries.op10_quality_rules(spark, sf_dir))
    for r in docs.select("doc_id", "text").collect():
        own = got[r["doc_id"]]
        expected = brute_rules(r["text"])
        assert tuple(own[1:6]) == expected, r["doc_id"]
        assert own["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (own["base_failed"] and own["kept"])


@pytest.mark.parametrize("text", ["a a a a", "a b c a b c", "a b c d a b c", "x\nx\n\n\nx", "a b a b a b a", "\n \n \n", "é é é é # | <>", "one two three"])
def test_rules_of_small_texts(spark, text):
    got = rules.measures(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == brute_rules(text)


def test_rules_edges(spark, odd):
    got = rules.judged(odd).collect()
    assert len(got) == len(ODD)
    assert rules.judged(odd.limit(0)).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"]


def test_hosts_fail_by_habit(spark):
    good = " ".join(f"w{i}" for i in range(60))
    noisy = " ".join(f"w{i}###" for i in range(60))
    rows = [(i, noisy, "bad", 0) for i in range(30)] + [(100 + i, good, "good", 0) for i in range(30)] + [(200, noisy, "good", 0), (201, good, "bad", 0)]
    got = by_id(rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string, n int")))
    assert not any(got[i]["kept"] for i in range(30))
    assert all(got[100 + i]["kept"] for i in range(30))
    assert got[200]["kept"] and got[201]["kept"]


def brute_verdicts(counts, rate=0.6, lift=3.0, deviations=2.0):
    """Bad hosts of one rule from {host: (documents, failures)}, number by number."""
    total, failures = sum(n for n, _ in counts.values()), sum(k for _, k in counts.values())
    mean, hosts, strength = failures / total, len(counts), 1e6
    if hosts > 1:
        m = (total - sum(n * n for n, _ in counts.values()) / total) / (hosts - 1)
        spread = sum(n * (k / n - mean) ** 2 for n, k in counts.values()) / (hosts - 1) / m
        noise = mean * (1 - mean) / m
        if m > 1 and spread > noise:
            strength = max(2.0, (mean * (1 - mean) - noise) / (spread - noise) - 1)
    bad = set()
    for host, (n, k) in counts.items():
        shrunk = (k + mean * strength) / (n + strength)
        low = shrunk - deviations * (shrunk * (1 - shrunk) / (n + strength + 1)) ** 0.5
        if low * (1 - mean) > lift * mean * (1 - low) or low > rate:
            bad.add(host)
    return bad


def test_hosts_decide_documents(spark, monkeypatch):
    """Among 40 hosts whose rates differ, documents of one text stay or go by their host; without the verdicts all would stay."""
    rng = np.random.default_rng(3)
    good, noisy = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60))
    rows, counts = [], {}
    for h in range(40):
        n = int(rng.integers(3, 60)) if h else 400
        p = 0.9 if h % 10 == 3 else 0.04
        failed = rng.random(n) < p
        counts[f"h{h}"] = (n, int(failed.sum()))
        rows += [(len(rows) + k, noisy if x else good, f"h{h}") for k, x in enumerate(failed)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = brute_verdicts(counts)
    assert 3 <= len(bad) < 40 and "h0" not in bad
    got = by_id(rules.judged(docs))
    assert all(got[i]["kept"] == (text == good or host not in bad) for i, text, host in rows)
    assert sum(not r["kept"] for r in got.values()) == sum(k for h, (_, k) in counts.items() if h in bad) > 50
    # Switched off, the method's verdict drops nothing.
    assert all(r["kept"] for r in rules.judged(docs, rate=2.0, lift=1e9).collect())


def test_one_document_follows_the_prior(spark):
    """A host of one failing document is not judged by it alone."""
    good, noisy = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}###" for i in range(60))
    rows = [(i, good, f"g{i % 20}") for i in range(200)] + [(300 + i, noisy, "bad") for i in range(30)] + [(400, noisy, "single")]
    got = by_id(rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert got[400]["kept"] and not got[300]["kept"]


def test_beta_prior():
    assert rules.beta_prior(10, 0.2, 0.2 * 0.8 / 10) == (0.2, 1e6)
    mean, strength = rules.beta_prior(10, 0.2, 0.2 * 0.8 * (1 + 9 / 5) / 10)
    assert (mean, strength) == (0.2, pytest.approx(4))
    assert rules.beta_prior(None, None, None) == (0.0, 1e6)


# Personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = []
    for k, (pattern, ok) in enumerate((
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if ok(m[0])]
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f a@-x@b.cc x@y @z.d a.b@c.d.", "1.2.3.4.5.6.7.8 300.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 1-2 4111111111111111-", "+1 (555) 555-1234 +1 +12(3 +123456789012345678",
    "😀 é a@b.de 10.0.0.1", "9" * 3000 + ".1.1.1", "a" * 3000 + "@b.c", "1 " * 3000, "x@a.b@c.d.e+1.2.3.4", "", "token = \"0123456789abcdef0123456789abcdef01234567\"",
]


@pytest.mark.parametrize("text", TRICKY)
def test_spans_of_tricky_texts(spark, text):
    got = pii.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").first()
    assert [tuple(x) for x in got["base"]] == brute_spans(text)


def test_pii_by_brute_force(spark, sf_dir, docs):
    got = by_id(queries.op7_pii(spark, sf_dir))
    for r in docs.select("doc_id", "text").collect():
        expected = brute_spans(r["text"])
        own = got[r["doc_id"]]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in expected)
        assert own["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [own[f"n_{kind}"] for kind in pii.KINDS[:4]] == [sum(k == j for _, k, _ in expected) for j in range(4)]
        assert set(joined.split(",")) - {""} <= set(own["spans"].split(","))


def test_contexts_are_learned_from_seeds(spark):
    key = "0123456789abcdef0123456789abcde"
    seeds = [(i, f'some words secret = "{key}{i}" end') for i in range(5)]
    unseen = [(10, 'more secret = "zz-99-top" here'), (11, 'page = "zz-98-top" here'), (12, "secret zz-97-top")]
    got = by_id(pii.identify(spark.createDataFrame(seeds + unseen, "doc_id long, text string"), "doc_id"))
    assert [x["k"] for x in got[10]["spans"]] == [4]
    s = got[10]["spans"][0]
    assert unseen[0][1][s["s"] : s["e"]] == "zz-99-top"
    assert got[11]["spans"] == [] and got[12]["spans"] == []
    assert len(got[0]["spans"]) == 1


def words_of(i):
    return f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"


def contexts_table(spark):
    """Emails and phones after \"contact\", keys after \"secret =\"; ids that no fixed pattern knows beside these words and others."""
    key = "0123456789abcdef0123456789abcde"
    rows = [f"{words_of(i)} contact u{i}@b.de {words_of(i + 9)} and more" for i in range(12)]
    rows += [f"{words_of(i)} the +1 (555) 555-12{i:02d} {words_of(i + 5)}" for i in range(6)] + ["the the the end of the day"] * 20
    rows += [f'some words secret = "{key}{i}" {words_of(i)}' for i in range(5)]
    rows += [f'more secret = "zz-9{i}-top" here' for i in range(2)] + [f"a password: zz-9{i}-top there" for i in range(2)] + [f"a password: {key}{i} there" for i in range(2)]
    unseen = {"contact jd-4411 please": "jd-4411", "the jd-4412 please": None, 'secret = "qq-77-low" x': "qq-77-low", "password: rr-66-mid x": "rr-66-mid", "page: rr-65-mid x": None}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, *unseen])], "doc_id long, text string")
    return docs, {len(rows) + i: (t, v) for i, (t, v) in enumerate(unseen.items())}


@pytest.mark.parametrize("most", [1000, 0])
def test_contexts_discover_unseen_identifiers(spark, monkeypatch, most):
    """Words beside seeds become patterns where most of their occurrences are beside seeds; what they find makes further patterns
    (password: by the values that secret = found). The second case joins tokens with the table of contexts."""
    monkeypatch.setattr(pii, "CONTEXTS", most)
    docs, unseen = contexts_table(spark)
    got = by_id(pii.identify(docs, "doc_id", "text"))
    for i, (text, value) in unseen.items():
        assert [text[x["s"] : x["e"]] for x in got[i]["spans"]] == ([value] if value else []), text
        assert not got[i]["base"]


def test_nothing_is_discovered_without_the_graph(spark, monkeypatch):
    """Switched off (no pattern is believable), the fixed patterns alone find none of the identifiers above."""
    monkeypatch.setattr(pii, "CONFIDENCE", 2.0)
    docs, unseen = contexts_table(spark)
    got = by_id(pii.identify(docs, "doc_id"))
    assert all(not got[i]["spans"] for i in unseen)


def brute_conf(docs):
    """One round of scores by hand: {context: (confidence, support)} of separators and words, from seeds alone."""
    edges, total = Counter(), Counter()
    for text in docs:
        base = [(s, e) for s, _, e in brute_spans(text)]
        own = [(s, e, True) for s, e in base]
        for m in re.finditer(r"[A-Za-z0-9_-]{6,}", text):
            if re.search("[0-9]", m[0]) and not any(s < m.end() and m.start() < e for s, e in base):
                own.append((*m.span(), bool(re.match(r"(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]{32,}$", m[0]))))
        for s, e, seed in own:
            left, right = text[:s], text[e:]
            for mark, side, pattern in (("=", left, pii.CONTEXT), ("<", left, pii.WORD_BEFORE), (">", right, pii.WORD_AFTER)):
                if m := re.search(pattern, side):
                    edges[mark + m[1].lower(), text[s:e], seed] += 1
        total.update(text.lower().split())
    out = {}
    for key in {k for k, _, _ in edges}:
        own = {(v, seed): n for (k, v, seed), n in edges.items() if k == key}
        if len(own) >= pii.SUPPORT:
            whole = max(sum(own.values()), 0 if key[0] == "=" else total[key[1:]])
            out[key] = (sum(n for (_, seed), n in own.items() if seed) / (whole + 0.5), sum(seed for _, seed in own))
    return out


def test_scores_by_hand(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 1)
    monkeypatch.setattr(pii, "CONFIDENCE", 0.0)
    docs, _ = contexts_table(spark)
    got = {r["key"]: r["conf"] for r in pii.patterns(docs).collect()}
    expected = {k: c for k, (c, n) in brute_conf([r["text"] for r in docs.collect()]).items() if n >= pii.SUPPORT}
    assert got == pytest.approx(expected) and "<contact" in got and '=secret = "' in got


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_rounds_by_hand_without_staging(spark, monkeypatch, rounds):
    """All rounds against a plain loop over the edges, with every context believed; however many there are, no more tables are written."""
    names, edges = [], []

    def staged(df, name):
        names.append(name)
        out = stage(df, name)
        edges.extend(out.collect() if name == "edges" else [])
        return out

    stage = pii.staged
    monkeypatch.setattr(pii, "staged", staged)
    monkeypatch.setattr(pii, "ROUNDS", rounds)
    monkeypatch.setattr(pii, "SUPPORT", 0)
    monkeypatch.setattr(pii, "CONFIDENCE", 0.0)
    docs, _ = contexts_table(spark)
    got = {r["key"]: r["conf"] for r in pii.patterns(docs).collect()}
    assert names == ["pairs", "often", "edges", "good"]
    seeds = {r["v"] for r in edges if r["seed"]}
    scores = {r["v"]: float(r["v"] in seeds) for r in edges}
    for _ in range(rounds):
        own = {k: [r for r in edges if r["key"] == k] for k in {r["key"] for r in edges}}
        conf = {k: sum(r["n"] * scores[r["v"]] for r in rs) / (max(r["total"] for r in rs) + 0.5) for k, rs in own.items()}
        scores = {v: 1.0 if v in seeds else 1 - math.prod(1 - min(conf[r["key"]], 0.99) for r in edges if r["v"] == v) for v in scores}
    assert got == pytest.approx(conf) and len(got) > 1


def test_blocks_change_nothing(spark):
    """Texts of many blocks, with and without places where blocks may end."""
    rng = np.random.default_rng(6)
    bits = ["a@b.de ", "10.0.0.1 ", "4111 1111 1111 1111 ", "+1 (555) 555-1234 ", "word ", "é😀 ", "12 ", "x1y2z3w4 ", "\n", "1-", "@", ". "]
    texts = ["".join(rng.choice(bits, 1500)) for _ in range(3)] + ["10.0.0.1 " * 700, "1 " * 4000, "a1" * 5000, ("x" * 1499 + " a@b.de ") * 3, "z" * 4000 + "@b.de", "\n" * 4000]
    for r in pii.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect():
        assert [tuple(x) for x in r["base"]] == brute_spans(texts[r["doc_id"]])


def test_long_texts_take_time_in_proportion(spark):
    import time

    def seconds(n):
        text = " ".join(f"key = ab{i:06d}x9 to u{i}@b.de" for i in range(n))
        start = time.monotonic()
        found = pii.found(spark.createDataFrame([(text,)], "text string"), "text").select(F.size("token"), pii.redacted(F.col("text"), F.transform("email", lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("k"), x["e"].alias("e"))))).first()
        assert found[0] == n and found[1] == re.sub("u[0-9]+@b.de", "<EMAIL>", text)
        return time.monotonic() - start

    seconds(100)
    few, many = seconds(10_000), seconds(80_000)
    assert many < 10 * few + 5


def test_redaction_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        text = "".join(rng.choice(list("ab é😀\n"), rng.integers(0, 60)))
        spans = sorted({(s := int(rng.integers(0, len(text))), int(rng.integers(0, 5)), int(rng.integers(s + 1, len(text) + 1))) for _ in range(rng.integers(0, 6)) if text})
        rows.append((text, spans))
    df = spark.createDataFrame(rows, "text string, spans array<struct<s:int,k:int,e:int>>").select(pii.redacted(F.col("text"), F.col("spans")))
    for (text, spans), r in zip(rows, df.collect(), strict=True):
        out, at = "", 0
        for s, k, e in spans:
            if s >= at:
                out += text[at:s] + f"<{pii.KINDS[k].upper()}>"
            at = max(at, e)
        assert r[0] == out + text[at:]


def test_pii_edges(spark, odd):
    got = pii.identify(odd, "doc_id", "extra").collect()
    assert len(got) == len(ODD)
    assert pii.identify(odd.limit(0), "doc_id").count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.de or 10.0.0.1!")], "doc_id long, text string")
    out = pii.identify(df, "doc_id", "text").select(pii.redacted(F.col("text"), F.col("spans"))).first()[0]
    assert out == "mail <EMAIL> or <IP>!"


def test_folds():
    assert zlib.crc32(b"17") % 5 == zlib.crc32(str(17).encode()) % 5


def test_fold_of_null(spark):
    df = spark.createDataFrame([(None,), (17,)], "doc_id long").select(fold_of(F.col("doc_id"), 5).alias("f"))
    assert sorted(r["f"] for r in df.collect()) == [-1, zlib.crc32(b"17") % 5]
