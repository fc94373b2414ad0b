"""Operator 3: toxicity by gradient-boosted trees over a few dense features, with isotonic calibration.

The lexicon is learned: words and word stems whose document frequency is much higher in toxic training texts. The features of a text are
densities of lexicon words by strength, how near they stand to second-person words, capitals, punctuation and obfuscated
spellings. The trees split on quantile bins and are grown in numpy on a bounded sample; the calibration is fitted on a
part of the sample that the trees have not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import labelled_sample, staged

#: Most rows of a class in the training sample, entries of the lexicon and size of its strong part.
PER_CLASS = 4000
LEXICON = 160
STRONG = 24
#: Lengths of stems, and words and stems that a task counts before it passes them on.
STEMS = range(3, 9)
HELD = 200_000
TREES, DEPTH, BINS, SHRINK = 60, 3, 32, 0.15

#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros su sus".split())
#: Characters that stand for letters in obfuscated spellings.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?=[A-Za-z@$!|]*[0-9@$!|])[A-Za-z0-9@$!|]*[A-Za-z][A-Za-z0-9@$!|]*")
#: Letters set apart by one mark each, 3 to 21 of them: longer runs are read in parts.
_SPACED = re.compile(r"(?<!\w)(?:\w[.\-*_ ]){2,20}\w(?!\w)")
NAMES = ("strong", "strong_distinct", "medium", "weak", "near_second", "second", "capitals", "punctuation", "obfuscated", "hidden_strong", "log_words", "mean_weight")


class Model(NamedTuple):
    lexicon: dict
    edges: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float
    knots: tuple[np.ndarray, np.ndarray]


def text_features(text: str, lexicon: dict) -> list[float]:
    """The features of NAMES for one text; all zero for an empty one. lexicon: word or stem* to (tier 0 to 2, weight); "" to the stems' first letters."""
    found = WORD.findall(text.lower())
    n = len(found)
    gate = lexicon.get("", ())
    hits = []
    for i, w in enumerate(found):
        if w in lexicon:
            hits.append((i, w, *lexicon[w]))
        elif w[:3] in gate:
            hits += [(i, w, *lexicon[f"{w[:k]}*"]) for k in STEMS if f"{w[:k]}*" in lexicon and len(w) > k]
    tiers = [0, 0, 0]
    for _, _, tier, _ in hits:
        tiers[tier] += 1
    strong = [i for i, _, tier, _ in hits if tier == 0]
    second = [i for i, w in enumerate(found) if w in SECOND_PERSON] if strong else []
    near = 0.0
    if second:
        at = np.array(second)
        for i in strong:
            k = int(np.searchsorted(at, i))
            near = max(near, 1.0 / (1 + min(abs(int(x) - i) for x in at[max(0, k - 1) : k + 1])))
    odd = hidden = 0
    for token in _MIXED.findall(text):
        plain = token.lower().translate(LEET)
        odd += 1
        hidden += bool(plain) and plain in lexicon and lexicon[plain][0] == 0
    for token in _SPACED.findall(text):
        plain = re.sub(r"[\W_]", "", token.lower()).translate(LEET)
        hit = bool(plain) and plain in lexicon and lexicon[plain][0] == 0
        hidden += hit
        odd += hit
    size = max(1, len(text))
    letters = sum(map(len, found))
    raised = sum(map(str.isupper, text)) if text else 0
    marks = size - letters - text.count(" ") - text.count("\n") if text else 0
    m = max(1, n)
    return [
        100.0 * tiers[0] / m,
        float(len({w for _, w, tier, _ in hits if tier == 0})),
        100.0 * tiers[1] / m,
        100.0 * tiers[2] / m,
        near,
        100.0 * len(second) / m,
        raised / max(1, letters),
        marks / size,
        100.0 * odd / m,
        float(hidden),
        float(np.log1p(n)),
        sum(x[3] for x in hits) / m,
    ]


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> dict:
    """Words and stems most typical of class 1 among distinct texts: by the difference of document shares, with their log odds.

    ``sample`` has (text, y) and is bounded; each distinct text counts once, so copies don't make words look typical. Of
    entries that say the same (a stem and its longer forms), the one with most evidence stays.
    """
    distinct = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in distinct.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[int]] = {}

        def passed_on() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(total), pa.string()), pa.array([x[0] for x in total.values()], pa.int64()), pa.array([x[1] for x in total.values()], pa.int64())], ["w", "a", "b"])
            total.clear()
            return out

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                own = set(WORD.findall(text.as_py().lower()))
                for w in own | {f"{w[:k]}*" for w in own for k in STEMS if len(w) > k}:
                    total.setdefault(w, [0, 0])[y] += 1
                if len(total) > HELD:
                    yield passed_on()
        yield passed_on()

    counts = distinct.select("text", "y").mapInArrow(run, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log(((F.col("b") + 0.5) / (toxic + 1)) / ((F.col("a") + 0.5) / (clean + 1)))
    # Evidence: the share's difference in standard errors, so that rare words and common ones compare.
    gap = F.col("b") / toxic - F.col("a") / clean
    pooled = (F.col("a") + F.col("b")) / float(toxic + clean)
    z = gap / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1.0 / toxic + 1.0 / clean))
    found = counts.where((F.col("b") >= 3) & (gap > 0)).select("w", odds.alias("odds"), z.alias("z")).orderBy(F.desc("z"), F.desc(F.length("w")), "w").limit(20 * size).collect()
    best: list = []
    for r in found:
        plain = r["w"].rstrip("*")
        if len(best) < size and not any(x["w"].startswith(plain) and r["w"].endswith("*") or x["w"].endswith("*") and plain.startswith(x["w"][:-1]) for x in best):
            best.append(r)
    strong = [r for r in best if r["odds"] > 1.5][:STRONG]
    # Of the strongest, only those within reach of the best one: the rest are chance finds of small samples.
    cut = 0.2 * strong[0]["z"] if strong else 0.0
    top = {r["w"] for r in strong if r["z"] >= cut}
    out: dict = {r["w"]: (0 if r["w"] in top else 1 if r["odds"] > 1.0 else 2, float(r["odds"])) for r in best}
    return out | {"": frozenset(w[:3] for w in out if w.endswith("*"))} if out else {}


def _bin(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[k], x[:, k], "right") for k in range(x.shape[1])], axis=1)


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, list, float]:
    """Boosted trees for the logistic loss: bin edges per feature, complete trees (feature, bin, leaf values) and the first log odds."""
    edges = np.stack([np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1]) for c in x.T])
    # Of a feature that is mostly zero, quantiles see nothing: half the edges split its non-zero values.
    for k, c in enumerate(x.T):
        if (c > 0).any():
            edges[k] = np.sort(np.concatenate([edges[k][::2], np.quantile(c[c > 0], np.linspace(0, 1, BINS // 2))[: BINS - 1 - len(edges[k][::2])]]))
    b = _bin(x, edges)
    share = float((weight * y).sum() / weight.sum())
    base = float(np.log(share / (1 - share)))
    f, trees, width = np.full(len(y), base), [], BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros((1 << DEPTH) - 1, np.int64), np.full((1 << DEPTH) - 1, BINS, np.int64)
        for depth in range(DEPTH):
            first, count = (1 << depth) - 1, 1 << depth
            best = np.full(count, 1e-9)
            for k in range(x.shape[1]):
                key = node * width + b[:, k]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 2) | (ht - hs < 2)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(count), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + count][better] = k
                cut[first : first + count][better] = at[better]
            node = 2 * node + (b[np.arange(len(y)), feature[first + node]] > cut[first + node])
        leaves = SHRINK * np.bincount(node, g, 1 << DEPTH) / (np.bincount(node, h, 1 << DEPTH) + 1)
        f += leaves[node]
        trees.append((feature, cut, leaves))
    return edges, trees, base


def raw_score(x: np.ndarray, edges: np.ndarray, trees: list, base: float) -> np.ndarray:
    b, f, rows = _bin(x, edges), np.full(len(x), base), np.arange(len(x))
    for feature, cut, leaves in trees:
        node = np.zeros(len(x), np.int64)
        for depth in range(DEPTH):
            first = (1 << depth) - 1
            node = 2 * node + (b[rows, feature[first + node]] > cut[first + node])
        f += leaves[node]
    return f


def isotonic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing fit: neighbours that fall are pooled until none does."""
    order = np.argsort(f, kind="stable")
    pools: list[list[float]] = []
    for s, t, w in zip(f[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([s, s, t * w, w])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    ends = np.array([[p[0], p[1]] for p in pools]).ravel()
    return ends, np.repeat([p[2] / p[3] for p in pools], 2)


def _measured(docs: DataFrame, lexicon: dict, *keep: str) -> DataFrame:
    slim = docs.select(*keep, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(t.as_py() or "", lexicon) for t in batch.column("text")]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"])

    return slim.mapInArrow(run, f"{types}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """Learn from at most about per_class labelled ids of each class where ``keep`` holds, one row of each; None unless both classes occur.

    Ids of null, labels other than 0 and 1, and null texts teach nothing. Rows are weighted back to the classes' shares among all labelled rows.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep)
    n = {int(r["y"]): int(r["n"]) for r in own.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    sample = staged(labelled_sample(docs, labels, label, keep, per_class, "toxicity"), "toxicity_sample")
    # The lexicon is learned on one half and the trees mostly on the other, so that they see honest densities.
    half = F.xxhash64("text") % 2 == 0
    lexicon = learn_lexicon(sample.where(half))
    if len(n) < 2 or not lexicon:
        return None
    rows = _measured(sample.withColumn("half", half), lexicon, "doc_id", "y", "half").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(rows.num_rows, len(NAMES))
    y, ids = rows.column("y").to_numpy().astype(np.float64), rows.column("doc_id").to_numpy()
    seen = rows.column("half").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    got = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, n[1] / got[1], n[0] / got[0])
    weight *= len(y) / weight.sum()
    fold = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)) % np.uint64(3) == 0
    fold &= ~seen
    if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
        fold[:] = True
    grown = ~fold if not fold.all() else fold
    edges, trees, base = grow(x[grown], y[grown], weight[grown])
    knots = isotonic(raw_score(x[fold], edges, trees, base), y[fold], weight[fold])
    return Model(lexicon, edges, trees, base, knots)


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """(keep..., score) of every row's whole text; null and empty texts have all features zero. Without a model all score 0.

    Texts are read whole, whatever their length; equal rows score alike; an empty table gives no rows. Columns besides text and
    keep are ignored; those of keep must not bear the name of the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*keep, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if m is not None and batch.num_rows:
                x = np.array([text_features(t.as_py() or "", m.lexicon) for t in batch.column("text")], np.float64)
                out = np.clip(np.interp(raw_score(x, m.edges, m.trees, m.base), *m.knots), 0.0, 1.0)
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(out)], [*keep, "score"])

    return slim.mapInArrow(run, f"{types}, score double")
