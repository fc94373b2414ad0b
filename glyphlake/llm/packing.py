"""Operator 1: pack tokenised documents into fixed-length sequences by large-item matching and best fit.

The plan is made on the histogram of piece lengths (at most ``capacity`` entries, whatever the corpus holds): lengths above
one third of the capacity are matched greedily in descending order, at most two to a sequence; shorter ones go, longest
first, to the sequences with the smallest remaining gap that holds them. Pieces then find their place by their rank
within their length, which is counted in cells so that no task holds all pieces of a frequent length.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import staged

#: Texts with an unbroken run this long go to the library whose merges are not quadratic in a run's length.
LONG_RUN = 1000


@lru_cache(2)
def _encoders(tokenizer: str, special: bool):
    """The named vocabulary in two libraries: merge ranks for speed, the file itself for texts with very long runs.

    The ranks are read from the same file, so both give the same ids.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)
    slow.encode_special_tokens = not special
    spec = json.load(open(tokenizer))  # noqa: SIM115
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    # Byte-level vocabularies spell each byte as a printable character (printable Latin-1 as itself, the rest from 256 on).
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(spelled[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added if special else {})
    return fast, slow


_RUN = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))


def encode(text: str, tokenizer: str, special: bool = True) -> np.ndarray:
    """The ids that the tokenizer file gives for a text, as uint32; with ``special``, its special tokens' names in a text count as such."""
    fast, slow = _encoders(tokenizer, special)
    if len(text) > LONG_RUN and _RUN.search(text):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and one end id, cut only where longer than capacity.

    The first piece takes what is over, all others are full. A null text counts as empty: one piece of the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or "", tokenizer), np.uint32(end_id)).astype("<u4")
                count = -(-len(ids) // capacity)
                at = 0
                for k in range(count):
                    to = len(ids) - (count - 1 - k) * capacity
                    for column, value in zip(rows, (doc_id, k, at, to - at, zlib.crc32(ids[at:to].tobytes())), strict=True):
                        column.append(value)
                    at = to
            yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where pieces of each length go: rows of (length, first rank, ranks, first sequence, offset).

    Pieces of ranks r to r + n - 1 of a length go to n consecutive sequences, all at the same offset. Each row uses up a
    length or fills a run of sequences, so rows are bounded by the capacity, not by the corpus.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("piece lengths must be from 1 to the capacity")
    out: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first sequence, sequences)
    opened = 0

    def put(s: int, n: int, at: int, offset: int) -> None:
        out.append((s, used[s], n, at, offset))
        used[s] += n
        left[s] -= n

    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] - (x == a) > 0), None)
            n = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            put(a, n, opened, 0)
            if b is not None:
                put(b, n, opened, a)
            gaps[capacity - a - (b or 0)].append((opened, n))
            opened += n
    open_gaps = [g for g in gaps if g]
    heapq.heapify(open_gaps)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            fitting = [g for g in open_gaps if g >= s and gaps[g]]
            g = min(fitting) if fitting else capacity
            if not fitting:
                n = -(-left[s] // (capacity // s))
                gaps[capacity].append((opened, n))
                opened += n
            at, n = gaps[g].pop()
            each = min(g // s, left[s])
            full = min(n, left[s] // each)
            if full < n:
                gaps[g].append((at + full, n - full))
            for k in range(each):
                put(s, full, at, capacity - g + k * s)
            gaps[g - each * s].append((at, full))
            open_gaps = [x for x in {*open_gaps, g, g - each * s} if x and gaps[x]]
    return out


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns, with ``length`` from 1 to capacity).

    Offsets in a sequence are gapless from 0. Which of the pieces of one length goes where is decided by their rows in the staged
    table, so rows of one id, of null ids, or equal in all are dealt over tasks like any others. Repeated rows are packed
    as often as they occur; an empty table stays empty.
    """
    schema = cut.schema.names
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    kept = F.struct(*[F.col(f"`{c}`") for c in schema]).alias("_piece")  # apart, so that no name clashes
    rows = staged(cut.select(kept, "length", F.monotonically_increasing_id().alias("row")), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    cell = max(200, int(sum(counts.values()) ** 0.5))
    spread = cut.sparkSession.createDataFrame([(s, -(-n // cell)) for s, n in counts.items()], "length long, cells long")
    dealt = rows.join(F.broadcast(spread), "length").withColumn("cell", F.pmod(F.xxhash64("row"), F.col("cells"))).drop("cells")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy("length", "cell").agg(F.count("*").alias("n")).select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "cell").orderBy("row")) - 1)
    ranked = ranked.join(staged(cells, "cells"), ["length", "cell"]).withColumn("rank", F.col("rank") + F.col("base"))
    places = np.array(sorted(plan(counts, capacity)) or [(0, 0, 0, 0, 0)], np.int64)
    keys = (places[:, 0] << 44) + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = places[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            yield pa.record_batch([*[batch.column(c) for c in schema], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], [*schema, "sequence_id", "offset"])

    return ranked.select("_piece.*", "rank").mapInArrow(run, f"{types}, sequence_id long, offset long")
