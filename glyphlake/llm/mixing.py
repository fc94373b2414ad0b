"""Operator 8: mix sources to target weights by whole copies and Pareto order sampling.

Each source's target gives an expected number of copies of its documents. The whole part is certain; for the rest,
documents are ranked by random odds over inclusion odds and taken from the front until their words fill what is left of
the target. The cut is found by counts in ever finer bins of the rank, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import staged, uniform, unstage, words

#: The weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Bins of each of the steps that find the cut; three go by the rank, the last by the text.
BINS = 1 << 12


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """(key, source_size, target) from (key, source_size): shares by weight, each at most ``most`` times the source's size.

    The excess over a cap is shared again by weight until no source is above its own: each round brings the words and the weight
    of the sources that stay below, one row, so that no task orders the sources. One row per source.
    """
    weighed = staged(_weighed(sizes).withColumn("cap", F.col("source_size") * F.lit(float(most))), "weights")
    total = (weighed.agg(F.sum("source_size").alias("n")).collect()[0]["n"] or 0) * float(share)
    level, below = None, F.lit(True)
    while True:
        sums = weighed.agg(F.sum(F.when(~below, F.col("cap"))).alias("cap"), F.sum(F.when(below, F.col("weight"))).alias("weight"), F.count(F.when(below, 1)).alias("n")).collect()[0]
        if not sums["n"]:
            level = None
            break
        now = (total - (sums["cap"] or 0.0)) / sums["weight"]
        if level is not None and now <= level:
            break
        level, below = now, F.col("cap") / F.col("weight") >= F.lit(now)
    capped = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return weighed.select("key", "source_size", capped.alias("target"))


def _weighed(sizes: DataFrame) -> DataFrame:
    """Weights by the place of the key in code-point order: places are counted within ranges of keys, and ranges offset."""
    spread = staged(sizes.repartitionByRange(F.col("key")).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = spread.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per range
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    return spread.join(base, "part").select("key", "source_size", weight.alias("weight"))


def mix(docs: DataFrame, *keep: str, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """(keep..., size, source_size, target, copies, taken): how often the mix takes each document.

    A null text has size 0: it is copied like others and adds no words. Documents of a null source form the last source. A document is taken at
    most ceil(most) times. The rank depends on the seed and the id alone, so reruns agree; documents of a null id, or of the same
    one, rank by their texts. Rows that are equal in id, text and source are one place in the order as many times as they
    occur: where the cut falls among them, as many are taken as fit. An empty table gives no rows. Columns besides doc_id,
    text, source and keep are ignored; those of keep must not bear the names of the result's own.

    What a document needs to know are its source's numbers, and in the bin of the cut its own place: two small tables,
    so texts need not move.
    """
    text = F.xxhash64("text")
    u = F.when(F.col("doc_id").isNull(), uniform(F.lit(seed), F.md5(F.coalesce("text", F.lit(""))))).otherwise(uniform(F.lit(seed), F.col("doc_id")))
    keys = [F.size(words(F.col("text"))).cast("long").alias("size"), _key(F.col("source")).alias("key"), u.alias("u"), text.alias("t")]
    slim = staged(docs.select("doc_id", *keys), "sizes")
    goals = targets(slim.groupBy("key").agg(F.sum("size").alias("source_size")), share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("whole", F.floor(ratio)).withColumn("part", ratio - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = staged(goals, "targets")
    ranked = staged(slim.join(goals, "key").withColumn("at", _bin()), "ranked")
    cut = _cut(ranked)
    goals = staged(goals.join(cut, "key", "left"), "cuts")
    equal = ranked.where("part > 0").join(cut, "key").where(F.col("at") == F.col("edge")).withColumn("q", _odds())
    equal = equal.groupBy("key", "at", "q", "doc_id", "size", "t").agg(F.count("*").alias("m"), F.first("words_before").alias("words_before"), F.first("rest").alias("rest"))
    before = Window.partitionBy("key", "at").orderBy("q", "doc_id", "size", "t").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("words_before") - F.coalesce(F.sum(F.col("m") * F.col("size")).over(before), F.lit(0)) - F.col("size") / 2
    fits = F.when(room < 0, 0).when(F.col("size") == 0, F.col("m")).otherwise(F.least(F.col("m"), F.floor(room / F.col("size")) + 1))
    last = staged(equal.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("t").alias("_t"), "m", fits.cast("long").alias("fits")), "last")
    unstage(slim, ranked)
    # Names of keep may be anything: they travel in a struct of their own.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_keep"), "doc_id", *keys).join(goals, "key").withColumn("at", _bin())
    match = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("t") == F.col("_t"))
    own = own.join(last, match, "left")
    extra = F.when((F.col("part") > 0) & ((F.col("at") < F.col("edge")) | ((F.col("at") == F.col("edge")) & (F.col("fits") > 0))), 1).otherwise(0)
    split = F.coalesce((F.col("part") > 0) & (F.col("at") == F.col("edge")) & (F.col("fits") > 0) & (F.col("fits") < F.col("m")), F.lit(False))
    names = ["_keep", "size", "source_size", "target", "whole"]
    if last.where("fits > 0 and fits < m").isEmpty():
        own = own.select(*names, extra.alias("extra"))
    else:
        some = staged(own.where(split).select(*names, "key", "fits").withColumn("row", F.monotonically_increasing_id()), "equal_rows")
        own = own.where(~split).select(*names, extra.alias("extra")).unionByName(_first_of(some).select(*names, "extra"))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return own.select("_keep.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _first_of(rows: DataFrame, cells: int = 200) -> DataFrame:
    """extra: 1 for as many rows of a key as ``fits`` says, by number; counted in cells, so that no task holds all rows of a key."""
    dealt = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy("key", "cell").agg(F.count("*").alias("n")).select("key", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("key", "cell").orderBy("row"))
    return dealt.join(counted, ["key", "cell"]).withColumn("extra", (place <= F.col("fits")).cast("int"))


def _odds() -> Column:
    """Pareto rank: random odds over inclusion odds; null where nothing is drawn."""
    u, part = F.col("u"), F.col("part")
    return F.when(part > 0, (u / (1 - u)) / (part / (1 - part)))


def _bin() -> Column:
    """The rank's place among BINS ** 3, ascending, and below it one of BINS by the text: documents of one id have one rank."""
    q = _odds()
    place = F.coalesce(F.floor(q / (1 + q) * BINS**3), F.lit(0)).cast("long")
    return place * BINS + F.pmod(F.col("t"), F.lit(BINS))


def _cut(ranked: DataFrame) -> DataFrame:
    """(key, edge, words_before): the finest bin of the rank in which a source's remaining words run out, and the words before it.

    Sums by bin are taken of all documents at first, then of those in the bin found, BINS times finer each time.
    """
    found = None
    for level in (3, 2, 1, 0):
        rows = ranked.where(F.col("part") > 0).withColumn("bin", F.floor(F.col("at") / BINS**level).cast("long"))
        if found is not None:
            rows = rows.join(found, "key").where(F.floor(F.col("bin") / BINS) == F.col("edge"))
        else:
            rows = rows.withColumn("words_before", F.lit(0).cast("long"))
        sums = rows.groupBy("key", "bin").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("words_before").alias("base"))
        order = Window.partitionBy("key").orderBy("bin")
        upto = sums.withColumn("upto", F.col("base") + F.sum("n").over(order))
        first = upto.where((F.col("upto") >= F.col("rest"))).groupBy("key").agg(F.min(F.struct("bin", "upto", "n")).alias("x"))
        found = first.select("key", F.col("x.bin").alias("edge"), (F.col("x.upto") - F.col("x.n")).alias("words_before"))
        found = staged(found, f"cut{level}")
    return found
