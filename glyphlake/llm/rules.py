"""Operator 10: quality rules per document, and per host with rates shrunk by an empirical beta prior.

DataFrame functions only. Each document is measured once; its soft failures are summed by host, each host's failure rate
is shrunk towards the corpus with a beta prior fitted by moments over all hosts, and the verdict on the host goes back to
its documents: a document is dropped for a soft failure only where its host fails that rule as a habit. A habit is judged by the
lower end of the host's shrunk rate, against the rate of the whole corpus or against a fixed share, so a host of few
documents is held to the corpus by the prior alone, and there is no least number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import staged, unstage, words

#: Soft rules: a name and a condition on the measures. One alone drops nothing.
SOFT = {
    "symbols": "10 * n_symbols > word_chars",
    "dup_lines": "n_lines >= 4 and 2 * n_dup_lines > n_lines",
    "repeats": "10 * n_repeat_words > 3 * n_words",
    "long_words": "word_chars > 14 * n_words",
}


def _covered(starts: Column) -> Column:
    """How many words lie in windows of three that begin at the given ascending positions."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n"), (p + 3).alias("end"))

    return F.aggregate(starts, zero, add, lambda acc: acc["n"])


def _let(value: Column, body) -> Column:
    """body of value, computed once: a lambda's variable, where a plain reference would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words in windows that occur twice or more: windows equal to a neighbour in the order by value, back in text order."""

    def marked(by_value: Column) -> Column:
        def starts(x: Column, j: Column) -> Column:
            return F.when((x["h"] == F.get(by_value, j - 1)["h"]) | (x["h"] == F.get(by_value, j + 1)["h"]), x["i"])

        return _covered(F.array_sort(F.filter(F.transform(by_value, starts), lambda i: i.isNotNull())))

    return _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), marked)


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of whole texts; null texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")

    def of_words(ws: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

        def repeats(h: Column) -> Column:
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_repeat_words(h))

        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.when(F.size(ws) >= 4, _let(windows, repeats)).otherwise(0).cast("long").alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    return docs.select(
        "doc_id",
        "source",
        F.inline(F.array(F.struct(
            _let(words(F.col("text")), of_words).alias("w"),
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _let(lines, of_lines).alias("l"),
        ))),
    ).select("doc_id", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def beta_prior(m: float | None, mean: float | None, var: float | None) -> tuple[float, float]:
    """Mean and strength of the beta prior whose hosts of m documents would have this mean and variance of rates.

    Var(rate) = mean (1 - mean) (1 + (m - 1) / (strength + 1)) / m; where rates vary no more than by chance, or cannot be
    compared, the strength is so great that all hosts get the mean.
    """
    mean, m, var = mean or 0.0, m or 1.0, var or 0.0
    most, noise = mean * (1 - mean), mean * (1 - mean) / m
    if var <= noise or m <= 1:
        return mean, 1e6
    return mean, max(2.0, (most - noise) / (var - noise) - 1)


def moments(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """For each rule m, mean and variance for ``beta_prior``, from hosts (n, k_rule...) of any sizes.

    Hosts weigh by their documents: S = sum n (k / n - mean)**2 has mean * (1 - mean) * (H - 1) * (1 + (m - 1) / (strength + 1))
    as its expected value, where m = (N - sum n**2 / N) / (H - 1) stands for the documents of a host and N for all documents.
    One row reaches the driver.
    """
    total = hosts.agg(F.count("*").alias("h"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), *[F.sum(f"k_{x}").alias(f"k_{x}") for x in names], *[F.sum(F.expr(f"double(k_{x}) * k_{x} / n")).alias(f"kk_{x}") for x in names]).collect()[0]
    out = {}
    for x in names:
        n, h = total["n"] or 0, total["h"]
        mean = total[f"k_{x}"] / n if n else 0.0
        m = (n - total["nn"] / n) / (h - 1) if h > 1 else 0.0
        # S in its short form: sum k**2 / n - N * mean**2.
        out[x] = (m, mean, (total[f"kk_{x}"] - n * mean * mean) / ((h - 1) * m) if m > 0 else 0.0)
    return out


def judged(docs: DataFrame, min_words: int = 50, rate: float = 0.6, lift: float = 3.0, deviations: float = 2.0) -> DataFrame:
    """Measures, base_failed, each soft failure, the host's shrunk rates and verdicts and kept, a row per document.

    base_failed: fewer than min_words words, or more than half of them in repeated windows. A document that passes is
    dropped where it fails a soft rule that its host fails as a habit (``bad_<rule>``): the host's shrunk rate, less
    ``deviations`` standard deviations of it, has odds above ``lift`` times those of the whole corpus, or lies above
    ``rate``. The host is ``source``; documents with a null source form a host of their own, and a host of one document is judged
    like any other, its rate being nearly the prior's. Null and empty texts have no words and fail. Texts are measured whole,
    whatever their length; repeated rows are counted and returned as often as they occur; an empty table gives none; columns
    besides doc_id, text and source are ignored.
    """
    soft = [F.expr(rule).cast("int").alias(f"soft_{name}") for name, rule in SOFT.items()]
    measured = measures(docs).withColumn("host", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = staged(measured.select("*", failed.alias("base_failed"), *soft), "measures")
    names = list(SOFT)
    hosts = staged(measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(f"soft_{x}").alias(f"k_{x}") for x in names]), "hosts")
    verdicts = hosts
    for x, (m, mean, var) in moments(hosts, names).items():
        mean, strength = beta_prior(m, mean, var)
        shrunk = (F.col(f"k_{x}") + mean * strength) / (F.col("n") + strength)
        verdicts = verdicts.withColumn(f"rate_{x}", shrunk)
        low = F.col(f"rate_{x}") - deviations * F.sqrt(F.col(f"rate_{x}") * (1 - F.col(f"rate_{x}")) / (F.col("n") + strength + 1))
        verdicts = verdicts.withColumn(f"low_{x}", low)
        over = F.col(f"low_{x}") * (1 - mean) > lift * mean * (1 - F.col(f"low_{x}"))
        verdicts = verdicts.withColumn(f"bad_{x}", over | (F.col(f"low_{x}") > rate))
    # Written, so that the planner knows the size of one row per host; a hot host is then no key of a shuffle.
    verdicts = staged(verdicts.select("host", F.col("n").alias("host_docs"), *[c for x in names for c in (f"rate_{x}", f"bad_{x}")]), "verdicts")
    unstage(hosts)
    bad = F.lit(False)
    for x in names:
        bad = bad | ((F.col(f"soft_{x}") == 1) & F.col(f"bad_{x}"))
    return measured.join(verdicts, "host").withColumn("kept", ~F.col("base_failed") & ~bad)
