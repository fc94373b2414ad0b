"""Operator 6: near-duplicate groups by SuperMinHash signatures, banding, exact verification and distributed union-find.

Documents with the same shingle set are one class from the start. Each class has a SuperMinHash signature: every shingle
draws a random permutation of the slots and leaves, at the slot of its j-th draw, the rank j and a random fraction; a
slot keeps the least. As ranks of one shingle differ between slots, estimates vary less than with independent hashes, and
a document stops drawing once no higher rank can enter. Bands of the signature bring candidates together.

Within a bucket not all pairs are formed. First each member meets the bucket's leader, then, as long as that joins many,
members of groups that are still apart meet other leaders; in the end all pairs of different groups that are left are
compared. Every pair of one bucket is thus either compared or inside one group, so no link between groups is lost, and a
bucket of n copies costs about n. Comparing means at first a bound that never errs: each set has a bitmap with the parity of
its shingles by hash, and two bitmaps differ in no more bits than the sets in elements. Only pairs that the bound leaves open
leave the join, and their full sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import mix64, span_hashes, staged, text_blocks, unstage, utf8, word_bounds

#: Signature slots; bands of ROWS slots each: a pair shares no band with probability 7e-9 at similarity 0.85, 3e-6 at 0.8.
SLOTS, ROWS = 160, 5
#: Bits of the bitmap, in words of 64.
MARKS = 16
#: Most rounds with leaders; share of bucket rows that a round must settle for another one; pairs per row that are always too many.
LEADER_ROUNDS, SETTLED, MANY = 10, 0.1, 500
#: Rows of a bucket that one task holds against the others when all pairs of different groups are compared.
SPLIT = 1000
#: Most classes whose ids are copied to all tasks to pick out their texts; beyond, texts are joined by id.
COPIED = 500_000

_MARK_NAMES = [f"s{k}" for k in range(MARKS)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANK = np.uint64(40)
_FRACTION = np.uint64((1 << 40) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Each document's distinct n-word shingles as sorted 64-bit hashes; texts of fewer words have one, of no words none."""
    data = _LOWER[data]
    starts, ends, words = word_bounds(data, offsets)
    hashes = span_hashes(data, starts, ends)
    size = max(0, len(hashes) - n + 1)
    joined = np.zeros(size, np.uint64)
    for k in range(n):
        joined = mix64(joined * np.uint64(3) + hashes[k : k + size])
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(joined[a : b - n + 1]))
        else:
            whole = np.full(min(1, b - a), b - a, np.uint64)
            for h in hashes[a:b]:
                whole = mix64(whole * np.uint64(5) + h)
            out.append(whole)
    return out


def word_shingles(text: bytes, n: int = 5) -> set[tuple[bytes, ...]]:
    """The distinct n-word shingles of a text in UTF-8, as words; of fewer words, the whole sequence."""
    words = text.translate(_LOWER.tobytes()).split()
    return set(zip(*[words[k:] for k in range(n)], strict=False)) if len(words) >= n else {tuple(words)} if words else set()


def super_minhash(elements: np.ndarray, doc: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """(docs, slots) of rank << 40 | fraction. elements: distinct per document; doc: the document of each, ascending."""
    out = np.full((docs, slots), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    live, at = elements, doc
    drawn: list[np.ndarray] = []  # partners of the swaps so far
    order: np.ndarray | None = None  # permutations in full, once there are many
    for j in range(slots):
        r = mix64(live + np.uint64(int(_STEP) * (j + 1) % (1 << 64)))
        k = (j + (r >> np.uint64(44)) % np.uint64(slots - j)).astype(np.int64)
        if order is None and j <= 4:
            slot = k.copy()
            for i in range(j - 1, -1, -1):  # where the swaps so far moved position k's value from
                was = drawn[i]
                slot = np.where(slot == i, was, np.where(slot == was, i, slot))
        else:
            rows = np.arange(len(live))
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8), (len(live), 1))
                for i, was in enumerate(drawn):
                    order[rows, i], order[rows, was] = order[rows, was], order[rows, i].copy()
            slot = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(flat, at * slots + slot, (np.uint64(j) << _RANK) | (r & _FRACTION))
        drawn.append(k)
        open_docs = (out.max(axis=1) >> _RANK) > np.uint64(j)
        keep = open_docs[at]
        if not keep.any():
            break
        if not keep.all():
            live, at = live[keep], at[keep]
            drawn = [x[keep] for x in drawn]
            order = None if order is None else order[keep]
    return out


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(docs, bands) of int64, the band's number hashed in."""
    docs, slots = signature.shape
    parts = signature[:, : slots // rows * rows].reshape(docs, -1, rows)
    h = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _STEP, parts.shape[:2]).copy()
    for k in range(rows):
        h = mix64(h * np.uint64(3) + parts[:, :, k])
    return h.view(np.int64)


def bitmaps(elements: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(docs, MARKS) of int64: for each of 64 * MARKS hash values, whether an odd number of elements has it."""
    width = 64 * MARKS
    odd = np.bincount(doc * width + (mix64(elements ^ _STEP) % np.uint64(width)).astype(np.int64), minlength=docs * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, width), axis=1).view(">i8").astype(np.int64)


def _key(unique: np.ndarray) -> bytes:
    return hashlib.blake2b(unique.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep..., n, c, bands, s0..): set size, 128-bit key of the set, band hashes and bitmap of every document."""
    own = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch, most=1 << 19):
                sets = shingles(data, offsets)
                sizes = np.array([len(s) for s in sets])
                joined, owner = np.concatenate(sets), np.repeat(np.arange(j - i), sizes)
                bands, bits = band_hashes(super_minhash(joined, owner, j - i)), bitmaps(joined, owner, j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1)))
                yield pa.record_batch(
                    [*[batch.column(x).slice(i, j - i) for x in own], pa.array(sizes.astype(np.int64)), pa.array([_key(s) for s in sets], pa.binary()), lists, *[pa.array(bits[:, k].copy()) for k in range(MARKS)]],
                    [*own, "n", "c", "bands", *_MARK_NAMES],
                )

    kept = "".join(f"`{x}` {docs.schema[x].dataType.simpleString()}, " for x in keep)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text").mapInArrow(run, f"doc_id long, {kept}n long, c binary, bands array<long>, " + ", ".join(f"{m} long" for m in _MARK_NAMES))


def _near(a: str, b: str, percent: int) -> Column:
    """False only where the sets cannot be similar enough: 100 * intersection >= percent * union holds exactly if
    (100 + percent) * (elements in one set alone) <= (100 - percent) * (sum of the sizes), and bitmaps differ in no more bits than that."""
    apart = sum((F.bit_count(F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}"))) for m in _MARK_NAMES), F.lit(0))
    least = F.greatest(apart, F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")))
    return (100 + percent) * least <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, m) of classes whose full shingle sets meet 100 * intersection >= percent * union."""
    left = texts.select(F.col("c").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("c").alias("m"), F.col("text").alias("text_m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, spelled = None, np.empty(0, np.uint64), (None, set())
        for batch in batches:
            a, m, keep = batch.column("a").to_pylist(), batch.column("m").to_pylist(), []
            ta, tm = utf8(batch.column("text_a")), utf8(batch.column("text_m"))
            for i in range(len(a)):
                if a[i] != last:
                    last = a[i]
                    part = ta[0][ta[1][i] : ta[1][i + 1]]
                    own = shingles(part, np.array([0, len(part)]))[0]
                part = tm[0][tm[1][i] : tm[1][i + 1]]
                other = shingles(part, np.array([0, len(part)]))[0]
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                both = int((own[at] == other).sum())
                if 100 * both >= percent * (len(own) + len(other) - both):
                    # Hashes decide against a link for sure; a link is held to the words themselves.
                    if a[i] != spelled[0]:
                        spelled = (a[i], word_shingles(ta[0][ta[1][i] : ta[1][i + 1]].tobytes()))
                    other_words = word_shingles(part.tobytes())
                    shared = len(spelled[1] & other_words)
                    if 100 * shared >= percent * (len(spelled[1]) + len(other_words) - shared):
                        keep.append(i)
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.binary()), pa.array([m[i] for i in keep], pa.binary())], ["a", "m"])

    return pairs.join(right, "m").join(left, "a").select("a", "m", "text_a", "text_m").mapInArrow(run, "a binary, m binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (u, v): the least node that links lead to, by alternating star contraction."""
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = staged(edges, "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").where(F.col("v") != F.col("w")).select(F.col("v").alias("u"), F.col("w").alias("v"))
        before, edges = edges, staged(small.unionByName(least.select("u", F.col("w").alias("v"))).distinct(), "edges")
        unstage(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).collect()[0]
        if state == now:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def group(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of docs.

    Two texts are linked if 100 * intersection >= percent * union of their sets of distinct 5-word shingles; component_id is
    the least doc_id that links lead to. Texts without words (null, empty, blank) link with nothing. Rows that share an id
    may have different texts; each row gets the component of its own text, equal rows the same. Rows of a null id take no
    part: their component is null and they are kept. Texts are read whole, whatever their length. An empty table gives no
    rows; other columns are ignored.
    """
    return rows_of_groups(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def rows_of_groups(docs: DataFrame, percent: int, *keep: str) -> DataFrame:
    """The columns of ``group``, keep, and comp: a key of the row's component (null: takes no part), as components of rows
    that share an id may have one component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    rows = staged(signatures(docs, *keep), "signatures")
    linked = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = staged(
        linked.groupBy("c").agg(F.min(F.struct("doc_id", "n", "bands", *_MARK_NAMES)).alias("x")).select("c", "x.*"),
        "classes",
    )
    slim = classes.select(F.explode("bands").alias("b"), "c")
    shared = slim.groupBy("b").agg(F.count("*").alias("size")).where("size > 1").select("b")
    members = staged(slim.join(shared, "b"), "members")
    labels = _linked(docs, classes, members, percent)
    owner = classes.select("c", "doc_id").join(labels, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = owner.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = staged(owner.join(least, "comp").select("c", "comp", "component_id"), "found")
    unstage(classes, members, labels)
    out = rows.select("doc_id", *keep, F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("c")).alias("c")).join(found, "c", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", *keep, "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), "comp")


def _met(one: DataFrame, all_rows: DataFrame, percent: int, once: bool, *also: str) -> DataFrame:
    """(a, m): rows of one bucket (and equal in ``also``), one of each side, of different groups, that may be similar enough; each pair
    in one order only where ``once`` says so."""
    x, y = one.alias("x"), all_rows.alias("y")
    apart = (F.col("x.comp") != F.col("y.comp")) & _near("x", "y", percent)
    for column in ("b", *also):
        apart = (F.col(f"x.{column}") == F.col(f"y.{column}")) & apart
    if once:
        apart = apart & (F.col("x.c") < F.col("y.c"))
    return y.join(x, apart).select(F.col("x.c").alias("a"), F.col("y.c").alias("m"))


def _linked(docs: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(c, comp) of all classes that share a bucket with another one; comp is the class's own key where nothing links."""
    own = members.select("c").distinct().withColumn("comp", F.col("c"))
    labels = staged(own, "labels")
    total = members.count()
    if not total:
        return labels
    need = staged(labels.select("c").join(classes.select("c", "doc_id", "n", *_MARK_NAMES), "c"), "need")
    texts = _texts(docs, need.select("c", "doc_id"), need.count())
    marks, tested, before, kept = need.drop("doc_id"), None, total, []
    for turn in range(LEADER_ROUNDS + 1):
        now = members.join(labels, "c")
        split = now.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("b")
        now = staged(now.join(split, "b").join(marks, "c"), "open")
        by = now.groupBy("b", "comp").agg(F.count("*").alias("k")).groupBy("b").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q"))
        found = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2), F.lit(0.0)).alias("pairs")).collect()[0]
        if not found["rows"]:
            break
        slow = turn and found["rows"] > (1 - SETTLED) * before
        last = found["pairs"] <= total or slow and found["pairs"] <= MANY * total or turn == LEADER_ROUNDS
        before = found["rows"]
        if last:
            one = now
        else:
            order = F.struct(F.xxhash64("c", F.lit(turn)).alias("o"), "c", "comp", "n", *_MARK_NAMES)
            one = now.groupBy("b").agg(F.min(order).alias("x")).select("b", "x.*").drop("o")
        pairs = _met(one, now, percent, last)
        if last:
            # Large buckets are dealt over several tasks: a row of one side goes to one of them, of the other side to each. The
            # others stay apart from them, as both sides of their join are then one exchange.
            sizes = staged(now.groupBy("b").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("deals")).where("deals > 1"), "deals")
            kept.append(sizes)
            if not sizes.isEmpty():
                rest, large = now.join(sizes, "b", "left_anti"), now.join(sizes, "b")
                dealt = large.withColumn("deal", F.pmod(F.xxhash64("c"), F.col("deals")).cast("int"))
                each = large.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
                pairs = _met(rest, rest, percent, last).unionByName(_met(dealt, each, percent, last, "deal"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "m"], "left_anti")
        pairs = staged(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        old, links = labels, verified(pairs, texts, percent)
        ends = links.join(labels.select(F.col("c").alias("a"), F.col("comp").alias("u")), "a").join(labels.select(F.col("c").alias("m"), F.col("comp").alias("v")), "m")
        merged = components(ends.select("u", "v")).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        labels = staged(labels.join(merged, "comp", "left").select("c", F.coalesce("to", "comp").alias("comp")), "labels")
        unstage(old, now)
        kept.append(pairs)
        if last:
            break
    unstage(texts, need, *kept)
    return labels


def _texts(docs: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """(c, text) of the wanted classes (c, doc_id), from a document whose text has the class's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("c").to_pylist()
            for i, j, data, offsets in text_blocks(batch):
                keep = [i + k for k, s in enumerate(shingles(data, offsets)) if _key(s) == wanted[i + k]]
                yield pa.record_batch([pa.array([wanted[k] for k in keep], pa.binary()), batch.column("text").take(pa.array(keep, pa.int64()))], ["c", "text"])

    found = docs.join(F.broadcast(need) if size <= COPIED else need, "doc_id").select("c", "text").mapInArrow(run, "c binary, text string")
    return staged(found.dropDuplicates(["c"]), "texts")
