"""Additive attribution of forest predictions (path-dependent tree Shapley values).

A leaf counts in so far as a row goes its way: for a subset of known features, the product over the
path's features of 1 or 0 if known and of the share of learning rows if not.  As a polynomial in t, the
chance that a feature is known, that product is a factor per feature, and a feature's Shapley value is
the integral over t of the product of all other factors.  Factors are gathered down the tree; the
integral of a polynomial is a short exact sum (Gauss-Legendre), so depth and the number of subsets do
not matter, only leaves times features.

Trees come in slices of the stored forest, rows in blocks; neither the driver nor a task holds all
leaves, and a row's values are summed over the slices.  Tasks run ``ForestValues`` in Java; ``attribute``
is the same in numpy, which forests of many features use.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.ml import jvm
from tillwise.ml.forest import Forest
from tillwise.ml.trees import Nodes, Rows

LEAVES_AT_ONCE = 8  # bits of a mask
MASKED_FEATURES = 16  # that ForestValues takes
DENSE = 1 << 18  # codes that a table may hold


def leaf_boxes(tree: Nodes, width: int) -> tuple[np.ndarray, ...]:
    """Per leaf: value, and per feature the bins low < x <= high that lead there and the share that does.

    The share is the part of the learning rows that goes the leaf's way at the splits on the feature.
    Leaves are listed from left to right, so that neighbours have most of their way in common.
    """
    cover = np.maximum(tree.a + tree.b, 1)
    levels, leaves = [np.zeros(1, np.int64)], np.ones(len(tree.feature), np.int64)
    while len(levels[-1]):
        inner = levels[-1][tree.feature[levels[-1]] >= 0]
        levels.append(np.concatenate([tree.left[inner], tree.right[inner]]))
    for at in reversed(levels):
        inner = at[tree.feature[at] >= 0]
        leaves[inner] = leaves[tree.left[inner]] + leaves[tree.right[inner]]
    at, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
    low, high, share = np.full((1, width), -1), np.full((1, width), 1 << 15), np.ones((1, width))
    found = []
    while len(at):
        leaf = tree.feature[at] < 0
        found.append((place[leaf], tree.a[at[leaf]] / cover[at[leaf]], low[leaf], high[leaf], share[leaf]))
        at, place, low, high, share = at[~leaf], place[~leaf], low[~leaf], high[~leaf], share[~leaf]
        f, cut, row = tree.feature[at], tree.bin[at], np.arange(len(at))
        sides = []
        for child, before in ((tree.left[at], 0), (tree.right[at], leaves[tree.left[at]])):
            lo, hi, part = low.copy(), high.copy(), share.copy()
            part[row, f] *= cover[child] / cover[at]
            sides.append((child, place + before, lo, hi, part))
        sides[0][3][row, f] = np.minimum(high[row, f], cut)
        sides[1][2][row, f] = np.maximum(low[row, f], cut)
        at, place, low, high, share = (np.concatenate(c) for c in zip(*sides, strict=True))
    place, *boxes = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(place)
    return tuple(c[order] for c in boxes)


def _shrunk(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct code in ``code``, all below ``size``, and the number of every code."""
    if size > DENSE:
        _, first, number = np.unique(code, return_index=True, return_inverse=True)
        return first, number.reshape(code.shape)
    table = np.full(size, -1, np.int64)
    table[code] = np.arange(len(code))
    seen = np.flatnonzero(table >= 0)
    first = table[seen]
    table[seen] = np.arange(len(seen))
    return first, table[code]


def _joined(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``_shrunk`` of rows of several codes."""
    code, size = columns[0].astype(np.int64), sizes[0]
    for c, n in zip(columns[1:], sizes[1:], strict=True):
        if size * n >= 1 << 62:
            first, code = _shrunk(code, size)
            size = len(first)
        code *= n
        code += c
        size *= n
    return _shrunk(code, size)


def attribute(x: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray):
    """Shapley values (rows x features) of the sum of some leaves.

    For a few neighbouring leaves, rows that every feature lets into the same ones are one; and for a
    leaf only the set of features that let a row in matters.  The integral is taken once per such set.
    """
    width = x.shape[1]
    spots, weights = np.polynomial.legendre.leggauss(width // 2 + 1)
    phi = np.zeros(x.shape)
    if not len(x):
        return phi
    columns = np.ascontiguousarray(x.T).astype(np.int64)
    bins = np.arange(columns.max() + 1)[:, None]
    for i in range(0, len(value), LEAVES_AT_ONCE):
        part = slice(i, i + LEAVES_AT_ONCE)
        lo, hi, sh, worth = low[part], high[part], share[part], value[part]
        gates = (bins[:, None] > lo) & (bins[:, None] <= hi)  # bin, leaf, feature
        masks = np.packbits(gates, axis=1)[:, 0]  # bin, feature
        classes, sizes = [np.zeros(len(x), np.int64)], [1]
        for f in range(width):
            used = np.zeros(1 << LEAVES_AT_ONCE, bool)
            used[masks[:, f]] = True
            if used.sum() > 1:
                number = np.cumsum(used) - 1
                classes.append(np.take(number[masks[:, f]], columns[f]))
                sizes.append(int(used.sum()))
        first, alike = _joined(classes, sizes)
        opened = [gates[columns[f][first], :, f].ravel() for f in range(width)]
        leaf = np.tile(np.arange(len(worth)), len(first))
        some, number = _joined([leaf, *opened], [len(worth)] + [2] * width)
        inside, at = np.stack([o[some] for o in opened], 1), leaf[some]
        gap, part_share = inside - sh[at], sh[at]
        each = np.zeros(gap.shape)
        for t, w in zip((spots + 1) / 2, weights / 2, strict=True):
            factor = part_share + t * gap
            each += gap / factor * (factor.prod(axis=1) * (w * worth[at]))[:, None]
        phi += each[number.reshape(len(first), -1)].sum(axis=1)[alike]
    return phi


def explain_rows(model: Forest, df: DataFrame, id_col: str) -> DataFrame:
    """Per row: base value and one contribution per feature; they add up to the class-1 probability.

    ``id_col`` is unique.
    """
    width, schema = len(model.features), "row bigint, base double, phi array<double>"
    spots, weights = np.polynomial.legendre.leggauss(width // 2 + 1)
    points = struct.pack(f"<2i{2 * len(spots)}d", width, len(spots), *((spots + 1) / 2), *(weights / 2))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for out in b.column("out"):
                data = out.as_buffer()
                n = int(np.frombuffer(data, "<i4", 1)[0])
                row, base = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "<f8", n, 4 + 8 * n)
                phi = pa.array(np.frombuffer(data, "<f8", n * width, 4 + 16 * n))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), phi)
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(base), listed], names=["row", "base", "phi"])

    def work(trees: list[Nodes], rows: Rows) -> pa.Table:
        phi, base = np.zeros(rows.x.shape), 0.0
        for tree in trees:
            value, *boxes = leaf_boxes(tree, width)
            phi += attribute(rows.x, value, *boxes)
            base += float((value * boxes[2].prod(axis=1)).sum())
        at = pa.array(np.arange(len(rows.row) + 1, dtype=np.int32) * width)
        listed = pa.ListArray.from_arrays(at, pa.array(phi.ravel()))
        return pa.table({"row": rows.row, "base": np.full(len(rows.row), base), "phi": listed})

    if width <= MASKED_FEATURES:
        function = jvm.java_function(df.sparkSession, "ForestValues")
        parts = model.in_pairs(df, id_col, function, points).mapInArrow(values, schema)
    else:
        parts = model.by_slices(df, id_col, work, schema)
    trees = model.trees
    sums = [(F.sum(F.col("phi")[i]) / trees).alias(f"_{i}") for i in range(width)]
    total = parts.groupBy("row").agg((F.sum("base") / trees).alias("base"), *sums)
    phi = F.array(*[f"_{i}" for i in range(width)]).alias("phi")
    ids = df.select(id_col, F.xxhash64(id_col).alias("row"))
    return ids.join(total, "row").select(id_col, "base", phi)


def explain_forest(model: Forest, df: DataFrame, id_col: str) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    rows = explain_rows(model, df, id_col)
    means = rows.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f) for i, f in enumerate(model.features)])
    listed = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_shap")) for f in model.features]
    )
    ranked = means.select(F.explode(listed).alias("r")).select("r.*")
    return ranked.orderBy(F.col("mean_abs_shap").desc(), "feature")
