"""Operator 4: similarity digests of improbable byte windows in chained Bloom filters.

Every 64-byte window of a text has an entropy; how rare that entropy is among the windows of the corpus ranks it. A
window is selected where it is the rarest (leftmost of ties) of its surroundings often enough. Selected windows enter a
chain of Bloom filters in text order, each closed at a fixed number of elements; two digests are compared by the bits
that their filters share beyond chance.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import mix64, text_blocks, utf8

#: Bytes of a window; windows that compete; wins that select one; levels of entropy.
WINDOW, RIVALS, WINS, LEVELS = 64, 64, 16, 1000
#: Bits and elements of a Bloom filter, bits set for an element.
FILTER_BITS, FILTER_ITEMS, HASHES = 2048, 160, 5
#: Bytes of text in a slice of ids, and most slices; more text then makes longer slices, which tasks read in blocks all the same.
SLICE, MOST_SLICES = 1 << 26, 2000
#: Share of the possible overlap beyond chance that still counts as none.
CHANCE = 0.3

# n log2 n for window counts, in steps fine enough that sums are exact integers.
_SCALE = 1 << 16
_NLOGN = np.array([0] + [round(n * np.log2(n) * _SCALE) for n in range(1, WINDOW + 1)], np.int64)
_GAIN = np.concatenate([[0], np.diff(_NLOGN)]).astype(np.int32)
_CHUNK = 1 << 16


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy of the window that starts at each byte, 0 to LEVELS; len(data) - WINDOW + 1 entries.

    The sum of n log n over a window's byte counts changes with the byte that enters and the one that leaves. How often
    each is in the window comes from comparing the text with itself shifted by 1 to 63 bytes.
    """
    size = len(data) - WINDOW + 1
    if size <= 0:
        return np.empty(0, np.int16)
    enter, leave = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for a in range(0, len(data), _CHUNK):
        part = data[max(0, a - WINDOW + 1) : a + _CHUNK]
        shift = a - max(0, a - WINDOW + 1)
        for d in range(1, WINDOW):
            first = max(shift, d)
            same = (part[first:] == part[first - d : len(part) - d]).view(np.uint8)
            base = a - shift
            enter[base + first : base + len(part)] += same
            leave[base + first - d : base + len(part) - d] += same
    change = _GAIN[enter[WINDOW:]] - _GAIN[leave[: size - 1]]
    total = np.empty(size, np.int64)
    total[0] = _NLOGN[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(change, out=total[1:])
    total[1:] += total[0]
    full = _NLOGN[WINDOW]
    return ((full - total) * LEVELS // full).astype(np.int16)


def _inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """Which of size window starts have their whole window in one text."""
    valid = np.zeros(size + 1, np.int32)
    lens = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    has = lens > 0
    np.add.at(valid, offsets[:-1][has], 1)
    np.add.at(valid, (offsets[:-1] + lens)[has], -1)
    return np.cumsum(valid[:-1]) > 0


def precedence(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level, 0 the rarest: from the windows at every byte of all texts, summed by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch):
                found = levels(data)
                total += np.bincount(found[_inside(offsets, len(found))], minlength=LEVELS + 1)
        yield pa.record_batch([pa.array(np.arange(LEVELS + 1)), pa.array(total)], ["level", "n"])

    found = docs.select("text").mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(LEVELS + 1, np.int64)
    for r in found:
        seen[r["level"]] = r["n"]
    order = np.lexsort((np.arange(LEVELS + 1), seen))
    rank = np.empty(LEVELS + 1, np.int32)
    rank[order] = np.arange(LEVELS + 1)
    return rank


def selected(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the selected windows in ascending order, and each text's bounds among them (n + 1).

    A text with windows has at least one selected: its rarest, leftmost. Texts shorter than a window have none.
    """
    size = max(0, len(data) - WINDOW + 1)
    last = np.iinfo(np.int64).max
    key = (rank[levels(data)].astype(np.int64) << 32) | np.arange(size)
    has = np.diff(offsets) >= WINDOW
    inside = _inside(offsets, size)
    key[~inside] = last
    # Windows of other texts are at least WINDOW - 1 invalid starts away, so that RIVALS consecutive starts meet one text's alone.
    best, span = key, 1
    while span < RIVALS:
        moved = np.full(size, last)
        moved[: max(0, size - span)] = best[span:]
        best, span = np.minimum(best, moved), span * 2
    winners = (best[inside] & np.int64(0xFFFFFFFF)).astype(np.int64)
    wins = np.bincount(winners, minlength=size)
    chosen = wins >= WINS
    if has.any():
        least = np.minimum.reduceat(key, offsets[:-1][has])
        chosen[least & np.int64(0xFFFFFFFF)] = True
    at = np.flatnonzero(chosen)
    return at, np.searchsorted(at, offsets)


def digests(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> list[list[np.ndarray]]:
    """Each text's chain of Bloom filters (FILTER_BITS bits packed in bytes). Texts shorter than a window: of the whole text."""
    at, bounds = selected(data, offsets, rank)
    rows = data[at[:, None] + np.arange(WINDOW)].view("<u8") if len(at) else np.empty((0, 8), np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(rows.shape[1]):
        h = mix64(h * np.uint64(3) + rows[:, k])
    width = FILTER_BITS.bit_length() - 1
    out: list[list[np.ndarray]] = []
    for i in range(len(offsets) - 1):
        own = h[bounds[i] : bounds[i + 1]]
        if not len(own) and offsets[i + 1] > offsets[i]:
            own = np.frombuffer(hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=8).digest(), np.uint64)
        if len(own) > 1:
            _, first = np.unique(own, return_index=True)
            own = own[np.sort(first)]
        chain = []
        for a in range(0, len(own), FILTER_ITEMS):
            bits = np.zeros(FILTER_BITS, np.uint8)
            part = own[a : a + FILTER_ITEMS]
            for k in range(HASHES):
                bits[(part >> np.uint64(k * width)) & np.uint64(FILTER_BITS - 1)] = 1
            chain.append(np.packbits(bits))
        out.append(chain)
    return out


def written(chain: list[np.ndarray]) -> str:
    """The digest as text: filters in base64, joined by points; empty for an empty text."""
    return ".".join(base64.b64encode(x.tobytes()).decode() for x in chain)


def read(digest: str) -> list[np.ndarray]:
    return [np.frombuffer(base64.b64decode(x), np.uint8) for x in digest.split(".")] if digest else []


def likeness(one: list[np.ndarray], two: list[np.ndarray]) -> float:
    """0 to 1: for each filter of the shorter chain the best normalised overlap with the other's, on average.

    The overlap of two filters counts from a share CHANCE of the way between what chance gives and the most possible.
    Two empty digests are alike (1), an empty one and another are not (0).
    """
    if not one or not two:
        return float(not one and not two)
    if len(one) > len(two):
        one, two = two, one
    a, b = np.stack(one).view("<u8"), np.stack(two).view("<u8")
    na, nb = np.bitwise_count(a).sum(axis=1).astype(float), np.bitwise_count(b).sum(axis=1).astype(float)
    total = 0.0
    for row, n in zip(a, na, strict=True):
        shared = np.bitwise_count(row & b).sum(axis=1)
        most = np.minimum(n, nb)
        chance = n * nb / FILTER_BITS
        floor = chance + CHANCE * (most - chance)
        total += float(np.clip((shared - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return total / len(one)


def edited(text: str, following: str) -> str:
    """The text with its last third (floor) replaced by the first as many code points of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def fingerprints(docs: DataFrame, slices: int = 0) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row of docs.

    The next document is the one that follows in descending doc_id, after the last comes the first; rows of one id follow
    by a hash of their text, descending, null ids come last, by that hash too. Null texts count as empty. An empty table gives no rows,
    a single row follows itself. Very long texts are read whole; columns besides doc_id and text are ignored.

    Ids are cut into slices of about equal rows, as many as SLICE bytes of text ask for; an id on more rows than a slice has is cut by the
    hashes of their texts. Each slice goes to one task of its own in order, with a copy of the first row of the slice that follows, so
    that every row meets the next one without ordering the corpus in one place. (Rows equal in id and text meet in one task.)
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rank = precedence(docs)
    whole = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes")).collect()[0]
    slices = slices or min(MOST_SLICES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(whole["bytes"] or 0) // SLICE)))
    marks = docs.select(F.percentile_approx("doc_id", [k / slices for k in range(1, slices)], 20 * slices).alias("m")).collect()[0]["m"] if slices > 1 else None
    # From the greatest id down: each mark that occurs once ends a slice; one that occurs r times is an id with r slices of its own.
    times = Counter(marks or [])
    marks, own, first, at = sorted(times, reverse=True), [0], [0], 1
    for m in marks:
        own.append(times[m] if times[m] > 1 else 0)
        first.append(at)
        at += own[-1] + 1
    nulls = max(1, round((whole["n"] - whole["ids"]) * slices / max(1, whole["n"])))
    ints = lambda xs: F.array(*[F.lit(int(x)) for x in xs]) if xs else F.array().cast("array<bigint>")
    text_hash = F.xxhash64("text")

    def part(t: Column, n: Column) -> Column:
        """Which of n equal parts of all hashes, from the greatest down."""
        return F.least(F.floor((F.lit(float(1 << 63)) - t.cast("double")) / float(1 << 64) * n), n - 1).cast("int")

    above = F.size(F.filter(ints(marks), lambda m: m >= F.col("doc_id")))
    keyed = docs.select("doc_id", "text", text_hash.alias("t"), F.when(F.col("doc_id").isNotNull(), above).alias("above"))
    hot, its = F.get(ints(own), F.col("above")), F.get(ints(marks), F.col("above") - 1) == F.col("doc_id")
    inside = F.when((hot > 0) & its, part(F.col("t"), hot)).otherwise(hot)
    slice_of = F.when(F.col("doc_id").isNull(), at + part(F.col("t"), F.lit(nulls))).otherwise(F.get(ints(first), F.col("above")) + inside)
    keyed = keyed.select("doc_id", "text", "t", slice_of.cast("int").alias("slice"))
    order = F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("t").alias("t"))
    firsts = keyed.groupBy("slice").agg(F.max(order).alias("x")).orderBy("slice").collect()  # a row per slice
    present = [int(r["slice"]) for r in firsts]
    heads = {s: (r["x"]["id"] if r["x"]["has"] else None, r["x"]["t"]) for s, r in zip(present, firsts, strict=True)}
    # Each slice's first row also goes, marked, to the end of the slice before it: a lookup with a row per slice.
    ahead = spark.createDataFrame([(*heads[s], present[k - 1]) for k, s in enumerate(present)], "h_id long, h_t long, also int")
    match = keyed["doc_id"].eqNullSafe(ahead["h_id"]) & (keyed["t"] == ahead["h_t"])
    keyed = keyed.join(F.broadcast(ahead), match, "left").drop("h_id", "h_t")
    places = F.array(F.struct(F.col("slice").alias("at"), F.lit(False).alias("extra")), F.struct(F.col("also").alias("at"), F.lit(True).alias("extra")))
    dealt = keyed.select("doc_id", "text", "t", F.explode(F.filter(places, lambda p: p["at"].isNotNull())).alias("p")).select("doc_id", "text", "t", "p.at", "p.extra")
    dealt = dealt.repartitionById(max(1, at + nulls), F.col("at")).sortWithinPartitions("at", "extra", F.desc_nulls_last("doc_id"), F.desc("t"))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def finish(rows: list[tuple], following: list[tuple]) -> pa.RecordBatch:
        """Rows (doc_id, text) with the texts that follow them, in order."""
        texts = [t for _, t in rows] + [following[-1][1]]
        later = [t for _, t in following]
        changed = [edited(t, n) for (_, t), n in zip(rows, later, strict=True)]
        chains: list[list[np.ndarray]] = []
        batch = pa.record_batch([pa.array(texts + changed, pa.large_string())], ["text"])
        for _, _, data, offsets in text_blocks(batch):
            chains += digests(data, offsets, rank)
        own, new = chains[: len(texts)], chains[len(texts) :]
        columns: list[list] = [[] for _ in names]
        for i, (doc_id, text) in enumerate(rows):
            values = (doc_id, len(text), hashlib.sha256(changed[i].encode()).hexdigest(), written(own[i]), written(new[i]), likeness(own[i], new[i]), likeness(own[i], own[i + 1]))
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, size, closed = None, 0, False
        for batch in batches:
            for doc_id, text, place, extra in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("at").to_pylist(), batch.column("extra").to_pylist(), strict=True):
                row = (doc_id, text.as_py())
                if place != at:
                    held, at, size, closed = [], place, 0, False
                if closed:  # rows equal to the extra one change nothing
                    continue
                if held and (extra or size > 1 << 20):
                    yield finish(held, [*held[1:], row])
                    held, size, closed = [], 0, extra
                if not extra:
                    held.append(row)
                    size += len(row[1])

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "at", "extra").mapInArrow(run, ddl)
