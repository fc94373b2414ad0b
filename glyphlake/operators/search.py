"""Search (Q1-Q10): scores of query vectors and postings by the words they share, and the best few of each query.

Only words that both sides share count: ||q - d|| = ||q|| + ||d|| + sum over shared words of (|q - d| - |q| - |d|). Where the best
few are wanted, sweeps find them without rows of pairs (``sweep``); where all pairs are, they are joined by word. Equal vectors
can be one class, which is scored once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.operators import sweep
from glyphlake.sources.tables import staged

SCORERS = ("l1", "l1_similarity", "min_hist", "cosine")


def shared_words(queries: DataFrame, postings: DataFrame, word: str = "word_id") -> DataFrame:
    """(query_id, image_id, q, d) for every word that a query and an image share."""
    q = queries.select(F.col("image_id").alias("query_id"), word, F.col("value").alias("q"))
    d = postings.select("image_id", word, F.col("weight").alias("d"))
    return q.join(d, word)


def l1_partial(q: Column, d: Column) -> Column:
    return F.sum(F.abs(q - d) - F.abs(q) - F.abs(d))


def score_l1(queries: DataFrame, postings: DataFrame, word: str = "word_id") -> DataFrame:
    """Q1: (query_id, image_id, score) of L1-normalised vectors, -2 for equal ones up to 0; images that share no word are absent."""
    return shared_words(queries, postings, word).groupBy("query_id", "image_id").agg(l1_partial(F.col("q"), F.col("d")).alias("score"))


def score_l1_similarity(queries: DataFrame, postings: DataFrame, word: str = "word_id") -> DataFrame:
    """Q8: half the negated L1 score, 0 to 1."""
    return score_l1(queries, postings, word).withColumn("score", F.col("score") * -0.5)


def full_l1(queries: DataFrame, postings: DataFrame, word: str = "word_id") -> DataFrame:
    """The L1 distance over the union of words, of pairs that share any: each side's sum of magnitudes, and the score of the
    shared words."""
    q = _weighed(queries, "image_id", F.col("value"), F.sum(F.abs("value")), word).select(F.col("image_id").alias("query_id"), word, F.col("x").alias("q"), F.col("whole").alias("a"))
    d = _weighed(postings, "image_id", F.col("weight"), F.sum(F.abs("weight")), word).select("image_id", word, F.col("x").alias("d"), F.col("whole").alias("b"))
    score = F.max("a") + F.max("b") + l1_partial(F.col("q"), F.col("d"))
    return q.join(d, word).groupBy("query_id", "image_id").agg(score.alias("distance"))


def _weighed(rows: DataFrame, image: str, value: Column, whole: Column, word: str) -> DataFrame:
    """(image, word, x, whole): a value of each word, and an aggregate over all words of the image."""
    return rows.select(image, word, value.alias("x"), whole.over(Window.partitionBy(image)).alias("whole"))


def _first(counted: DataFrame, cutoff: int) -> DataFrame:
    """The rows of the images that share most words with each query, later ids first on ties."""
    order = Window.partitionBy("query_id").orderBy(F.desc("shared"), F.desc("image_id"))
    return counted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cutoff).drop("_n")


def candidates(queries: DataFrame, postings: DataFrame, cutoff: int = 4096, word: str = "word_id") -> DataFrame:
    """Q5: (query_id, image_id, shared): the images that share most words with each query, later ids first on ties."""
    own, images = _bags(queries, "value", word), _bags(postings, "weight", word)
    return sweep.most_shared(own, images, cutoff)


def _bags(rows: DataFrame, value: str, word: str, *also: str) -> DataFrame:
    return staged(sweep.bags(rows, F.col(value), *map(F.col, also), word=word), "bags")


def score_min_hist(queries: DataFrame, postings: DataFrame, idf: DataFrame, cutoff: int = 4096, word: str = "word_id") -> DataFrame:
    """Q5/Q6: histogram intersection: over shared words min(q / a, d / b) * idf, a and b each side's sum of count * idf.

    Raw counts are divided by weighted sums on purpose; all words of an image count towards its sum, those without an idf
    for the cutoff alone. Each side is divided before the one join, which counts shared words and sums at once.
    """

    q = _shares(queries, "value", "q", idf, word).withColumnRenamed("image_id", "query_id")
    d = _shares(postings, "weight", "d", idf, word).drop("idf")
    # least skips nulls, which here stand for a side without weight.
    score = F.sum(F.when(F.col("q").isNotNull() & F.col("d").isNotNull(), F.least("q", "d") * F.col("idf")))
    both = q.join(d, word).groupBy("query_id", "image_id").agg(F.count("*").alias("shared"), F.coalesce(score, F.lit(0.0)).alias("score"))
    return _first(both, cutoff).drop("shared")


def _shares(rows: DataFrame, value: str, name: str, idf: DataFrame, word: str) -> DataFrame:
    """(image_id, word, name, idf): each value as a share of the image's weighted sum."""
    whole = F.sum(F.col(value) * F.col("idf")).over(Window.partitionBy("image_id"))
    share = F.col(value) / F.nullif(whole, F.lit(0.0))
    return rows.join(idf, word, "left").select("image_id", word, share.alias(name), "idf")


def _unit(rows: DataFrame, value: str, idf: DataFrame, word: str) -> DataFrame:
    """(image_id, word, unit): values times idf, divided by their root of squares; a vector of length 0 stays zero."""
    w = F.col(value) * F.col("idf")
    own = _weighed(rows.join(idf, word), "image_id", w, F.sum(w * w), word)
    return own.select("image_id", word, F.coalesce(F.col("x") / F.nullif(F.sqrt("whole"), F.lit(0.0)), F.lit(0.0)).alias("unit"))


def score_cosine(queries: DataFrame, postings: DataFrame, idf: DataFrame, word: str = "word_id") -> DataFrame:
    """Q7: cosine of idf-weighted vectors; norms run over all words of each side, products over shared ones."""

    def side(rows: DataFrame, value: str, key: str, name: str, norm: str) -> DataFrame:
        w = F.col(value) * F.col("idf")
        return _weighed(rows.join(idf, word), "image_id", w, F.sum(w * w), word).select(F.col("image_id").alias(key), word, F.col("x").alias(name), F.sqrt("whole").alias(norm))

    q, d = side(queries, "value", "query_id", "q", "nq"), side(postings, "weight", "image_id", "d", "nd")
    dots = q.join(d, word).groupBy("query_id", "image_id").agg(F.sum(F.col("q") * F.col("d")).alias("dot"), (F.max("nq") * F.max("nd")).alias("norms"))
    return dots.select("query_id", "image_id", F.coalesce(F.col("dot") / F.nullif(F.col("norms"), F.lit(0.0)), F.lit(0.0)).alias("score"))


def top_n(scored: DataFrame, n: int = 64, ascending: bool = True, decimals: int = 9) -> DataFrame:
    """Q10: (query_id, image_id, score, rank): the best n of each query (n <= 0: all), ties by the lower image id.

    Scores are compared after rounding, so that sums of another order rank alike.
    """
    by = F.round("score", decimals)
    order = Window.partitionBy("query_id").orderBy(by.asc() if ascending else by.desc(), "image_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n) if n > 0 else ranked


def search(queries: DataFrame, postings: DataFrame, scorer: str = "l1", top: int = 64, cutoff: int = 4096, idf: DataFrame | None = None, word: str = "word_id", alike: bool = False) -> DataFrame:
    """Q1-Q3, Q5-Q8: ranked matches of a batch of queries; all queries go together.

    alike: many vectors are equal, as those of a few words are, so equal ones are searched once (l1, l1_similarity).
    """
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}; one of {', '.join(SCORERS)}")
    if scorer in ("min_hist", "cosine") and idf is None:
        raise ValueError(f"{scorer} needs the words' idf")
    up = scorer == "l1"
    if top <= 0:
        if scorer == "min_hist":
            return top_n(score_min_hist(queries, postings, idf, cutoff, word), top, up)
        if scorer == "cosine":
            return top_n(score_cosine(queries, postings, idf, word), top, up)
        return top_n((score_l1 if up else score_l1_similarity)(queries, postings, word), top, up)
    if scorer == "min_hist":
        own = _bags(_shares(queries, "value", "x", idf, word), "x", word, "idf")
        return top_n(sweep.best(own, _bags(_shares(postings, "weight", "x", idf, word), "x", word), "least", top, up, within=cutoff), top, up)
    if scorer == "cosine":
        own, images = (_bags(_unit(rows, value, idf, word), "unit", word) for rows, value in ((queries, "value"), (postings, "weight")))
        return top_n(sweep.best(own, images, "product", top, up), top, up)
    own, images, scale = _bags(queries, "value", word), _bags(postings, "weight", word), 1.0 if up else -0.5
    if alike:
        return _best_alike(own, images, "l1", top, up, scale)
    return top_n(sweep.best(own, images, "l1", top, up, scale=scale), top, up)


def search_bags(images: DataFrame, asked: Column | str, scorer: str = "l1", top: int = 64, cutoff: int = 4096) -> DataFrame:
    """Q1-Q3, Q5-Q8: ``search`` of those bags of words (image_id, words, x: counts; staged) whose ids are asked for, against all, by tf-idf.

    Words are held as bags throughout: no table of postings is moved.
    """
    if scorer not in SCORERS:
        raise ValueError(f"unknown scorer {scorer!r}; one of {', '.join(SCORERS)}")
    df, n, up = sweep.frequencies(images), images.count(), scorer == "l1"
    term = {"cosine": "product", "min_hist": "least"}.get(scorer, "l1")
    whole = sweep.with_sums(images, df, n, 2 if scorer == "cosine" else 1)
    queries = sweep.weighted(whole.where(asked), df, n, term)
    found = sweep.best(queries, whole, term, top, up, scale=-0.5 if scorer == "l1_similarity" else 1.0, within=cutoff if scorer == "min_hist" else None)
    return top_n(found, top, up)


def _classes(bags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One bag of each class of equal ones, under its least image's id, and (image_id, member) of all images."""
    first = bags.groupBy("words", "x").agg(F.min("image_id").alias("first"))
    members = bags.join(first, ["words", "x"]).select(F.col("first").alias("image_id"), F.col("image_id").alias("member"))
    return staged(first.select(F.col("first").alias("image_id"), "words", "x"), "classes"), staged(members, "members")


def _best_alike(own: DataFrame, images: DataFrame, term: str, top: int, up: bool, scale: float = 1.0, decimals: int = 9) -> DataFrame:
    """The ranked best of each query by way of classes: the best images of a query are among the first of its best classes."""
    (queries, asked), (classes, members) = _classes(own), _classes(images)
    found = sweep.best(queries, classes, term, top, up, decimals, scale)
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("member"))
    first = members.withColumn("_n", place).where(F.col("_n") <= top).drop("_n")
    each = found.join(first, "image_id").select("query_id", F.col("member").alias("image_id"), "score")
    ranked = top_n(each, top, up, decimals)
    return ranked.join(asked.select(F.col("image_id").alias("query_id"), "member"), "query_id").select(F.col("member").alias("query_id"), "image_id", "score", "rank")


def by_class(queries: DataFrame, postings: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """All rows of a score of pairs (queries, postings by word_id), which is computed once for each two classes of equal vectors."""
    (own, asked), (images, members) = _classes(_bags(queries, "value", "word_id")), _classes(_bags(postings, "weight", "word_id"))
    rows = lambda bags, value: bags.select("image_id", F.inline(F.arrays_zip(F.col("words").alias("word_id"), F.col("x").alias(value))))
    scored = staged(score(rows(own, "value"), rows(images, "weight")), "class_pairs")
    each = scored.join(asked.select(F.col("image_id").alias("query_id"), F.col("member").alias("_q")), "query_id").drop("query_id")
    each = each.join(members.withColumnRenamed("member", "_d"), "image_id").drop("image_id")
    return each.select(F.col("_q").alias("query_id"), F.col("_d").alias("image_id"), *[c for c in scored.columns if c not in ("query_id", "image_id")])


def bow_search(*_args) -> DataFrame:
    """Q9: a bare bag of words holds no index to search."""
    raise NotImplementedError("bags of words are searched through an index: see search()")


def leaf_candidates(queries: DataFrame, vectors: DataFrame, cutoff: int) -> DataFrame:
    """Q4: (query_id, image_id): the images in the first ``cutoff`` entries of the query's leaves, by the query's value at the leaf,
    greatest first (compared after rounding; ties: lower node), then by image id.

    Lists that begin behind the cutoff are not read: the sizes of the lists before a leaf say where its own begins.
    """
    q = queries.select(F.col("image_id").alias("query_id"), "node_id", F.col("value").alias("q"))
    sizes = vectors.groupBy("node_id").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("query_id").orderBy(F.round("q", 9).desc(), "node_id").rowsBetween(Window.unboundedPreceding, -1)
    begun = q.join(sizes, "node_id").withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("before") < cutoff)
    # A list's order is the same for all queries, and none reads beyond its first cutoff entries.
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("image_id"))
    lists = vectors.select("image_id", "node_id").withColumn("place", place).where(F.col("place") <= cutoff)
    return begun.join(lists, "node_id").where(F.col("before") + F.col("place") <= cutoff).select("query_id", "image_id").distinct()


def search_nodes(queries: DataFrame, vectors: DataFrame, cutoff: int | None, top: int, leaves: DataFrame | None = None) -> DataFrame:
    """Q4: images in the first ``cutoff`` entries of the query's leaves (see ``leaf_candidates``), ranked by L2 distance over node vectors.

    Both tables are (image_id, node_id, value) with unit or zero length per image, so the distance follows from the inner
    product: |a - b|^2 = |a|^2 + |b|^2 - 2 ab, and only shared nodes are joined, of the candidates alone. ``leaves`` has the
    node_id of those nodes that have lists of images; without it all have. Without a cutoff (None) and without leaves all images
    that share a node count, and equal vectors are searched once.
    """
    if cutoff is None and leaves is None:
        return _best_alike(_bags(queries, "value", "node_id"), _bags(vectors, "value", "node_id"), "l2", top, True).withColumn("score", F.round("score", 9))
    listed = (queries, vectors) if leaves is None else [x.join(leaves.select("node_id").distinct(), "node_id", "left_semi") for x in (queries, vectors)]
    near = leaf_candidates(*listed, (1 << 62) if cutoff is None else cutoff)

    def side(rows: DataFrame, key: str, name: str, square: str) -> DataFrame:
        own = _weighed(rows, "image_id", F.col("value"), F.sum(F.col("value") * F.col("value")), "node_id")
        return own.select(F.col("image_id").alias(key), "node_id", F.col("x").alias(name), F.col("whole").alias(square))

    both = near.join(side(queries, "query_id", "q", "qq"), "query_id").join(side(vectors, "image_id", "d", "dd"), ["image_id", "node_id"])
    dots = both.groupBy("query_id", "image_id").agg(F.sum(F.col("q") * F.col("d")).alias("dot"), (F.max("qq") + F.max("dd")).alias("squares"))
    distance = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") - 2 * F.col("dot")))
    return top_n(dots.select("query_id", "image_id", F.round(distance, 9).alias("score")), top)
