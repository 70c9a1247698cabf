"""Links between the members of buckets, without all pairs of a large group of likes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import connected_groups
from tillwise.session import materialize

CHECKED_ROWS = 200_000
SMALL = 64  # rows of a bucket whose pairs are all made
MATRIX = 100_000  # pairs compared at a time


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joins a stored table of few narrow rows; it is broadcast only when counting finds it small."""
    return big.join(F.broadcast(small) if small.count() <= CHECKED_ROWS else small, on, how)


NAMES = ["bucket", "node", "tag", "n"]
LED = "bucket bigint, node bigint, tag bigint, n bigint, lead bigint"
Close = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
May = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets of two rows or more, from rows sorted by bucket and node; no node twice."""
    held: list[list[np.ndarray]] = []

    def give() -> Iterator[list[np.ndarray]]:
        cols = shared_buckets([np.concatenate(x) for x in zip(*held, strict=True)])
        if len(cols[0]):
            yield cols

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(x).to_numpy(zero_copy_only=False) for x in names]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or (held and held[-1][0][-1] != cols[0][0]):
            held.append([c[:last] for c in cols])
            yield from give()
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield from give()


def _buckets(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return start, np.diff(start, append=len(bucket))


def _small_pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places i < j within the buckets."""
    j = np.repeat(start, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    before = j - np.repeat(start, size)
    i = np.repeat(j - before, before) + (np.arange(before.sum()) - np.repeat(np.cumsum(before) - before, before))
    return i, np.repeat(j, before)


def _pair_blocks(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places i < j within the buckets, about ``MATRIX`` at a time."""
    i, j = _small_pairs(start[size <= SMALL], size[size <= SMALL])
    for first in range(0, len(i), MATRIX):
        yield i[first : first + MATRIX], j[first : first + MATRIX]
    for lo, m in zip(start[size > SMALL], size[size > SMALL], strict=True):
        step = max(1, MATRIX // m)
        for first in range(0, m, step):
            x, y = np.arange(first, min(first + step, m)), np.arange(first, m)
            i, j = np.nonzero(x[:, None] < y[None])
            yield lo + x[i], lo + y[j]


def leads_of(cols: list[np.ndarray], close: Close) -> pa.RecordBatch:
    """Rows of whole buckets with the first mate that is close; rows of small buckets close to none are left out."""
    bucket, node, tag, n = cols
    lead = np.arange(len(bucket))
    keep = np.zeros(len(bucket), bool)
    start, size = _buckets(bucket)
    i, j = _small_pairs(start[size <= SMALL], size[size <= SMALL])
    near = close(tag[i], n[i], tag[j], n[j])
    i, j = i[near], j[near]
    keep[i] = keep[j] = True
    np.minimum.at(lead, j, i)
    for lo, m in zip(start[size > SMALL], size[size > SMALL], strict=True):
        keep[lo : lo + m] = True
        left = np.arange(lo, lo + m)
        while len(left):
            near = close(tag[left[:1]], n[left[:1]], tag[left], n[left])
            lead[left[near]] = left[0]
            left = left[~near]
    arrays = [*(c[keep] for c in cols), node[lead[keep]]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=[*NAMES, "lead"])


def shared_buckets(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows, sorted by bucket and node, of the buckets with two nodes or more; no node twice."""
    same = cols[0][1:] == cols[0][:-1]
    keep = np.ones(len(cols[0]), bool)
    keep[1:] = ~same | (cols[1][1:] != cols[1][:-1])
    cols = [c[keep] for c in cols]
    start, size = _buckets(cols[0])
    return [c[np.repeat(size > 1, size)] for c in cols]


def _leads(close: Close):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_buckets(batches, NAMES):
            found = leads_of(cols, close)
            if found.num_rows:
                yield found

    return run


def settled(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` places the least that a path of the pairs i, j leads to."""
    least = np.arange(n)
    while len(i):
        low = np.minimum(least[i], least[j])
        new = least.copy()
        np.minimum.at(new, least[i], low)
        np.minimum.at(new, least[j], low)
        while (new[new] != new).any():
            new = new[new]
        least = new[least]
        open_ = least[i] != least[j]
        i, j = i[open_], j[open_]
    return least


def _across(close: Close):
    """Rows with a close mate in another group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, tag, n, root in _whole_buckets(batches, [*NAMES, "root"]):
            keep = np.zeros(len(bucket), bool)
            start, size = _buckets(bucket)
            i, j = _small_pairs(start[size <= SMALL], size[size <= SMALL])
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
            near = close(tag[i], n[i], tag[j], n[j])
            keep[i[near]] = keep[j[near]] = True
            for lo, m in zip(start[size > SMALL], size[size > SMALL], strict=True):
                part, step = slice(lo, lo + m), max(1, MATRIX // m)
                names, which, times = np.unique(root[part], return_inverse=True, return_counts=True)
                odd = np.flatnonzero(which != times.argmax())  # of two in different groups, one is not in the largest
                for x in np.split(odd, range(step, len(odd), step)):
                    near = close(tag[part][x, None], n[part][x, None], tag[part][None], n[part][None])
                    near &= which[x, None] != which[None]
                    keep[lo + x] |= near.any(1)
                    keep[part] |= near.any(0)
            if keep.any():
                arrays = [pa.array(c[keep]) for c in (bucket, node, root)]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "node", "root"])

    return run


def _mates(may: May):
    """Rows with a bucket mate in another group that ``may`` lets pass, with the last of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, root, n, sketch in _whole_buckets(batches, ["bucket", "node", "root", "n", "sketch"]):
            bits = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(bucket), -1)
            lead, keep = np.arange(len(bucket)), np.zeros(len(bucket), bool)
            for i, j in _pair_blocks(*_buckets(bucket)):
                open_ = root[i] != root[j]
                i, j = i[open_], j[open_]
                near = may(n, bits, i, j)
                i, j = i[near], j[near]
                keep[i] = keep[j] = True
                np.maximum.at(lead, i, j)
            if keep.any():
                arrays = [pa.array(c[keep]) for c in (bucket, node, n, sketch, node[lead])]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "node", "n", "sketch", "lead"])

    return run


def _meet(may: May):
    """Pairs of bucket mates in different groups that ``may`` lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, root, n, sketch in _whole_buckets(batches, ["bucket", "node", "root", "n", "sketch"]):
            sketch = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(bucket), -1)
            for i, j in _pair_blocks(*_buckets(bucket)):
                open_ = root[i] != root[j]
                i, j = i[open_], j[open_]
                keep = may(n, sketch, i, j)
                i, j = node[i[keep]], node[j[keep]]
                if len(i):
                    arrays = [pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["a", "b"])

    return run


def _ties(close: Close):
    """Each row with the least of its bucket that a path of close mates leads to; rows alone are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, node, tag, n in _whole_buckets(batches, NAMES):
            start, size = _buckets(bucket)
            i, j = _small_pairs(start[size <= SMALL], size[size <= SMALL])
            near = close(tag[i], n[i], tag[j], n[j])
            least = settled(i[near], j[near], len(bucket))
            for lo, m in zip(start[size > SMALL], size[size > SMALL], strict=True):
                left = np.arange(lo, lo + m)
                while len(left):
                    first, left, front = left[0], left[1:], [left[:1]]
                    while front and len(left):
                        x = front.pop()
                        near = close(tag[x[:1]], n[x[:1]], tag[left], n[left])
                        if len(x) > 1:
                            front.append(x[1:])
                        if near.any():
                            front.append(left[near])
                            least[left[near]] = first
                            left = left[~near]
            tied = np.flatnonzero(least != np.arange(len(least)))
            if len(tied):
                a, b = node[least[tied]], node[tied]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def close_families(members: DataFrame, close: Close) -> DataFrame:
    """(node, root) of the families in which any two close bucket mates are together.

    ``members`` and ``close`` are those of ``close_links``.  A bucket gives fewer ties than it has rows, so
    a family of any size comes without its pairs; whoever compares its members finds all that are alike.
    """
    sorted_ = members.repartition("bucket").sortWithinPartitions("bucket", "node")
    return connected_groups(sorted_.mapInArrow(_ties(close), "a bigint, b bigint"))


def close_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], close: Close) -> DataFrame:
    """(node, root) of the groups that verified pairs of close bucket mates connect.

    ``members`` has bucket, node, tag and n, all bigint; ``close`` compares tags and n of rows and says
    no only to pairs that ``verify`` would not return.  Each member meets one close mate first; verified,
    these make groups; then close mates that are still in different groups are verified too.  Pairs within
    a group cannot change the groups and are never built.  Pairs are made within sorted buckets, so members
    move and no product is shuffled but for the pairs that are close.
    """
    sorted_ = members.repartition("bucket").sortWithinPartitions("bucket", "node")
    return led_links(materialize(sorted_.mapInArrow(_leads(close), LED)), verify, close)


def led_links(
    shared: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    close: Close,
    traits: DataFrame | None = None,
    may: May = lambda n, sketch, i, j: np.ones(len(i), bool),
) -> DataFrame:
    """The groups of ``close_links`` from the stored rows of ``leads_of``.

    Rows with a close mate that is still in another group meet again, with the n and sketch that ``traits`` has for
    their node: first each with one mate that ``may`` lets pass by these, which joins most groups; then all such pairs
    that are still in different groups become rows and go to ``verify``.
    """
    stars = shared.filter("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    stars = materialize(stars.distinct())
    groups = materialize(connected_groups(materialize(verify(stars).select("a", "b"))))
    placed = shared.join(groups, "node", "left").select(*NAMES, F.coalesce("root", "node").alias("root"))
    placed = placed.repartition("bucket").sortWithinPartitions("bucket", "node")
    open_ = materialize(placed.mapInArrow(_across(close), "bucket bigint, node bigint, root bigint"))
    if open_.isEmpty():
        return groups
    if traits is None:
        open_ = open_.select("*", F.lit(0).cast("bigint").alias("n"), F.lit(bytes(8)).alias("sketch"))
    else:
        open_ = open_.join(traits, "node").select("bucket", "node", "root", "n", "sketch")
    sorted_ = open_.repartition("bucket").sortWithinPartitions("bucket", "node")
    mates = "bucket bigint, node bigint, n bigint, sketch binary, lead bigint"
    mates = materialize(sorted_.mapInArrow(_mates(may), mates))
    if mates.isEmpty():
        return groups
    tried = mates.filter("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    tried = materialize(tried.distinct().join(stars, ["a", "b"], "left_anti"))
    groups = materialize(_joined(groups, verify(tried)))
    left = mates.join(groups, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), "n", "sketch")
    sorted_ = left.repartition("bucket").sortWithinPartitions("bucket", "node")
    rest = sorted_.mapInArrow(_meet(may), "a bigint, b bigint").distinct()
    rest = materialize(rest.join(stars.union(tried), ["a", "b"], "left_anti"))
    return groups if rest.isEmpty() else _joined(groups, verify(rest))


def _joined(groups: DataFrame, more: DataFrame) -> DataFrame:
    """The groups that stay apart when the pairs ``more`` are linked too."""
    ties = groups.select(F.col("root").alias("a"), F.col("node").alias("b"))
    return connected_groups(ties.union(more.select("a", "b")))
