"""Shared pieces: byte-level words of an Arrow batch, word shingles, folds, connected groups.

Words are what ``[^\\x20\\x09-\\x0D]+`` finds after lower-casing A-Z, so they can be cut from the
UTF-8 bytes of a whole Arrow column at once, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.session import materialize

SHINGLE = 5
SIMILARITY = 0.8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so that it can be inverted modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(which: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base or of its inverse, kept for the next batch."""
    have = _POWERS[which]
    if len(have) < n:
        base = np.uint64(_BASE if which == "up" else _BASE_INV)
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _POWERS[which] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, so that nearby inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """All words of some texts laid end to end; words of text i are ``at[i]:at[i + 1]``."""

    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    cuts: np.ndarray  # byte offsets of the texts

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return mix(span_hashes(self.data, self.start, self.end))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of the byte spans ``start:end``, equal for equal bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers("up", len(data)), out=sums[1:])
    return (sums[end] - sums[start]) * _powers("down", len(data) + 1)[start]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of a string column and the offset of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data and len(column) else _LOWER[:0]
    return _LOWER[raw], cuts - cuts[0]


def cut_words(data: np.ndarray, cuts: np.ndarray, between: np.ndarray = _SPACE) -> Words:
    """Words of the texts ``cuts[i]:cuts[i + 1]``; a word never crosses a cut.

    ``between`` flags the bytes that are in no word.
    """
    word = np.zeros(len(data) + 1, bool)
    np.logical_not(between[data], out=word[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    begins = word[:-1].copy()
    begins[1:] &= ~word[:-2] | edge[1:-1]
    ends = word[:-1] & (~word[1:] | edge[1:])
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, cuts), cuts)


def batch_words(column: pa.Array) -> Words:
    return cut_words(*text_bytes(column))


def shingle_hashes(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and their offsets per text; shorter texts have none."""
    h = words.hashes()
    n = np.maximum(np.diff(words.at) - (k - 1), 0)
    at = np.concatenate([[0], np.cumsum(n)])
    if len(h) < k:
        return np.zeros(0, np.uint64), at
    runs = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        runs = runs * np.uint64(0x100000001B3) + h[j : len(h) - k + 1 + j]
    inside = np.repeat(words.at[:-1], n) + (np.arange(at[-1]) - np.repeat(at[:-1], n))
    return mix(runs[inside]), at


def small_batches(
    batches: Iterator[pa.RecordBatch], most: int = 2_000_000, column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``most`` bytes of text, one row at least; bounds the memory of a task."""
    for b in batches:
        if not b.num_rows:
            continue
        text = b.column(column).cast(pa.large_binary())
        ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0)))
        first = 0
        while first < b.num_rows:
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + most, "right")), first + 1)
            yield b.slice(first, last - first)
            first = last


def text_or_empty(docs: DataFrame, column: str = "text") -> Column:
    return F.coalesce(docs[column], F.lit(""))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(5)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_A_BATCH = 2_000


def ship(spark: SparkSession) -> None:
    """Makes the package importable on executors, and batches of whole texts small.

    A task holds a batch several times, on both sides of its pipe to Python; 10,000 texts, Spark's own number, are
    tens of megabytes each time.  A smaller number that the session has stays.
    """
    from tillwise.session import ship_package

    ship_package(spark)
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= TEXTS_A_BATCH:
        spark.conf.set(BATCH_ROWS, str(TEXTS_A_BATCH))


def connected_groups(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected ``edges``; root is the least node of its group.

    Alternating star contraction: in each round all neighbours of a node are tied to its least
    neighbour, until nothing moves.  Every round is written to the shared scratch folder, so a lost
    executor repeats one round only; the driver sees two sums per round.
    """
    e = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v")
        .distinct()
    )
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("u > m").select("u", F.col("m").alias("v"))).distinct()
        e = materialize(large.filter("u <> v"))
        down = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(down, "u").select("u", "v", "m")
        tied = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(tied.union(down.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = e.agg(
            F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))
        ).first()
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
