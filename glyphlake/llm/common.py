"""Helpers shared by the training-data operators: staged tables, labelled samples and byte blocks for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.sources.tables import read as table
from glyphlake.sources.tables import staged, unstage

__all__ = ["SPACES", "WORD", "fold_of", "labelled_sample", "mix64", "span_hashes", "spans", "staged", "sums_by", "table", "text_blocks", "uniform", "unstage", "utf8", "without", "word_bounds", "words"]

#: Java regular expression of a word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Bytes of text that one numpy block holds; whole documents only, so one long document makes a larger block.
BLOCK_BYTES = 1 << 20


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids count as fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the given columns alone: 52 bits of their MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, seed: str) -> DataFrame:
    """(doc_id, text, y) of at most about per_class ids of each class, a row for each: of rows that share an id, the one whose
    text has the least hash.

    Ids qualify where ``keep`` holds for doc_id and the label is 0 or 1; those of a class are taken by a hash of the id
    below per_class / class size, so the sample is bounded, repeatable and needs no ordering of the corpus. Ids that occur
    with several labels count as 1 if any row says so.
    """
    own = (
        labels.select(F.col("doc_id"), F.col(label).alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
        .groupBy("doc_id")
        .agg(F.max("y").cast("int").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    limit = F.lit(0.0)
    for y, n in sizes.items():
        limit = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(limit)
    picked = own.where(uniform(F.lit(seed), F.col("doc_id")) < limit)
    # At most about 2 * per_class ids of 12 bytes each: bounded by the parameter, whatever the corpus holds.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where(F.col("text").isNotNull())
    # One text for an id in each task, before any moves: an id on very many rows sends no more than others.
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes sum to about ``most``; every row is in one, long rows alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for consecutive whole documents of a batch."""
    data, offsets = utf8(batch.column(column))
    for i, j in spans(np.diff(offsets), most):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of words before it (n + 1 entries)."""
    solid = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Two prime moduli below 2**31, each with a base of its own; products of two residues fit into 64 bits.
_MODULI = ((np.uint64((1 << 31) - 1), np.uint64(1_103_515_246)), (np.uint64(2_147_483_629), np.uint64(742_938_285)))
_BYTE_KEY = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int, base: np.uint64, modulus: np.uint64) -> np.ndarray:
    """base**0 to base**(n - 1) modulo a prime, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * (out[size - 1] * base % modulus) % modulus
        size += more
    return out[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """62-bit hashes, mixed to 64, of ascending byte spans that don't overlap and aren't empty: equal spans, equal hashes.

    Polynomials of keyed bytes modulo two primes: sums modulo a power of two would let long words of regular structure collide.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    first = np.zeros(len(starts), np.int64)
    np.cumsum(sizes[:-1], out=first[1:])
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    own = data[place + np.repeat(starts, sizes)]
    longest = int(sizes.max())
    out = sizes.astype(np.uint64)
    for modulus, base in _MODULI:
        terms = (_BYTE_KEY % modulus)[own] * _powers(longest, base, modulus)[place] % modulus
        out = (out * np.uint64(3)) ^ mix64(np.add.reduceat(terms, first) % modulus + (out << np.uint64(32)))
    return mix64(out)


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; zero for empty ranges."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


#: Bits for each key of ``without``, and the most that it copies to all tasks.
KEY_BITS, MOST_BITS = 16, 1 << 27


def without(rows: DataFrame, gone: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is not among those of ``gone``, a staged table of distinct keys; rows of a null key stay.

    A bitmap of the keys' hashes goes to all tasks. Only rows whose bit is set, those that go and a few others, meet the keys
    themselves, so that the rest and its texts stay where they are, however many keys there are.
    """
    bits = 1 << 15
    wanted = min(MOST_BITS, KEY_BITS * gone.count())
    while bits < wanted:
        bits *= 2
    place = F.pmod(F.xxhash64(*[F.col(k).cast(gone.schema[k].dataType) for k in key]), F.lit(bits))
    at = F.bitmap_bit_position(place)
    bitmap = gone.groupBy(F.bitmap_bucket_number(place).alias("_gone_in")).agg(F.bitmap_construct_agg(at).alias("_gone_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_gone_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_gone_in", F.bitmap_bucket_number(place)).join(F.broadcast(staged(bitmap, "bitmap")), "_gone_in", "left")
    found = found.withColumn("_gone_set", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_gone_in", "_gone_bits")
    stay, open_ = found.where(~F.col("_gone_set")).drop("_gone_set"), found.where("_gone_set").drop("_gone_set")
    return stay.unionByName(open_.join(gone, list(key), "left_anti").select(*[F.col(f"`{c}`") for c in stay.columns]))
