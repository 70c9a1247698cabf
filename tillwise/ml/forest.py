"""Forests of unlimited depth with a least number of rows to split, and a whole grid from few of them.

A forest is grown by ``trees``: rows count as often as a Poisson draw says, nodes look at a few
features, leaves keep the weighted share of class 1.  Held-out rows travel with the rows a tree learns
from and are scored where the tree is grown, so validating needs no model at all.

Since every draw is a hash of the tree and the path, a tree of less depth, or with more rows asked for
before a split, is a truncation of the full tree; and the first hundred trees are a forest of a hundred.
So one growth per fold and least leaf size scores every depth, split size and number of trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.ml import jvm
from tillwise.ml.boost import NODE_SCHEMA, top_rows, trees_of
from tillwise.ml.metrics import auc_by
from tillwise.ml.trees import (
    Nodes,
    Part,
    Rows,
    Rule,
    Tree,
    bin_edges,
    binned_rows,
    dealer,
    empty_table,
    scramble,
    tops_and_parts,
)
from tillwise.params import DEFAULTS
from tillwise.session import materialize

WEIGHT_UNIT = 2.0**16
SHARE_UNIT = 2.0**40
TREES_PER_PART = 100
TREE_ROWS = 1_000_000  # rows of a tree that a task grows from the root: some 80 bytes each
NODES_PER_SLICE = 200_000
ROWS_PER_BLOCK = 50_000
NODES_PER_PAIR = 1_000_000  # some 40 bytes each
ROWS_PER_PAIR = 150_000  # some 200 bytes each

_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


@dataclass
class Bootstrap:
    """Channels of a row: 1 and its weight in its class, times how often the tree draws it."""

    def __call__(self, tree: Tree, rows: Rows):
        index = np.flatnonzero(rows.fold != tree.fold)
        even = scramble(rows.row[index].astype(np.uint64) ^ scramble(np.uint64(tree.key)))
        times = np.searchsorted(_POISSON, (even >> np.uint64(11)) / 2.0**53, "right")
        index, times = index[times > 0], times[times > 0]
        weight = np.rint(rows.weight[index] * WEIGHT_UNIT).astype(np.int64) * times
        one = rows.label[index] == 1
        return index, np.ones(len(index), np.int64), np.where(one, weight, 0), np.where(one, 0, weight)


@dataclass(frozen=True)
class Stop:
    """Where a full tree is cut: a node at ``max_depth`` or with fewer than ``min_split`` rows ends."""

    max_depth: int | None = None
    min_split: int = 2


def share_of(nodes: Nodes) -> np.ndarray:
    """Class 1 share of each node in units."""
    return np.rint(nodes.a / np.maximum(nodes.a + nodes.b, 1) * SHARE_UNIT).astype(np.int64)


def stopped_shares(nodes: Nodes, x: np.ndarray, root: int, stops: list[Stop]) -> np.ndarray:
    """The share each row gets under each stop, one walk for all of them."""
    share = share_of(nodes)
    out = np.zeros((len(stops), len(x)), np.int64)
    row, at, open_ = np.arange(len(x)), np.full(len(x), root), np.ones(out.shape, bool)
    while len(row):
        leaf = nodes.feature[at] < 0
        for s, stop in enumerate(stops):
            ends = leaf | (nodes.n[at] < stop.min_split)
            if stop.max_depth is not None:
                ends |= nodes.depth[at] == stop.max_depth
            here = open_[s] & ends
            out[s][row[here]] = share[at[here]]
            open_[s] &= ~ends
        further = open_.any(axis=0)
        row, at, open_ = row[further], at[further], open_[:, further]
        low = x[row, nodes.feature[at]] <= nodes.bin[at]
        at = np.where(low, nodes.left[at], nodes.right[at])
    return out


def trees_a_part(counts: list[int], fits: int, cores: int) -> int:
    """Trees that one copy of the rows serves: as many as leave two parts a core; they divide ``counts``."""
    fitting = [d for d in range(1, TREES_PER_PART + 1) if all(c % d == 0 for c in counts)]
    return max(d for d in fitting if d == 1 or fits * max(counts) // d >= 2 * cores)


def _trees(fits: list[tuple[int, Rule]], trees: int, seed: int) -> list[Tree]:
    """Trees of all fits; tree i has the same key in every fit."""
    keys = scramble(np.arange(trees) + (seed << 32))
    return [
        Tree(fit * trees + i, int(keys[i]), fold, rule)
        for fit, (fold, rule) in enumerate(fits)
        for i in range(trees)
    ]


def rule_of(width: int, min_leaf: int = 1, max_depth: int | None = None, min_split: int = 2) -> Rule:
    """Gini splits that look at the root of the number of features."""
    return Rule("gini", max_depth, min_split, min_leaf, max(int(np.sqrt(width)), 1))


def _in_parts(
    rows: DataFrame, width: int, tops: dict, parts: list[Part], ends: list[tuple[int, int]] | None, most: int
) -> DataFrame:
    """What ``ForestPart`` makes of each part: shares of held-out rows where ``ends`` are given, else nodes."""
    if any(p.trees[0].rule.kind != "gini" for p in parts):
        raise ValueError("forests split by gini")
    wanted = [jvm.forest_part(p, width, WEIGHT_UNIT, _POISSON, ends, most) for p in parts]
    blocks = jvm.blocks_of_parts(rows, len(parts), dealer(tops, parts, Bootstrap()))
    return jvm.over_parts(jvm.java_function(rows.sparkSession, "ForestPart"), wanted, blocks)


def _held_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for out in b.column("out"):
            data = out.as_buffer()
            n, stops, fit, number = np.frombuffer(data, "<i4", 4)
            row = np.frombuffer(data, "<i8", n, 16)
            sums = np.frombuffer(data, "<i8", n * stops, 16 + 8 * n)
            label = np.frombuffer(data, "<i4", n, 16 + 8 * n * (1 + stops))
            shares = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * stops), pa.array(sums))
            same = [pa.array(np.full(n, v), pa.int32()) for v in (fit, number)]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(row), pa.array(label), shares], names=["fit", "number", "row", "label", "sums"]
            )


def _grown_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    for b in batches:
        for out in b.column("out"):
            data = np.frombuffer(out.as_buffer(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in data[1:].reshape(len(names), data[0])], names=names)


def held_out_scores(
    rows: DataFrame,
    width: int,
    fits: list[tuple[int, Rule]],
    stops: list[Stop],
    counts: list[int],
    seed: int = DEFAULTS.seed,
    local_rows: int = TREE_ROWS,
) -> DataFrame:
    """(fit, stop, trees, row, label, score): held-out rows under every stop and number of trees.

    ``fits`` are (fold, rule); ``counts`` are numbers of trees, of which the largest is grown.
    """
    most = max(counts)
    per_part = trees_a_part(counts, len(fits), rows.sparkSession.sparkContext.defaultParallelism)

    planted, size = _trees(fits, most, seed), rows.count()
    tops, parts = tops_and_parts(rows, width, planted, Bootstrap(), size, per_part, local_rows)
    ends = [(-1 if s.max_depth is None else s.max_depth, s.min_split) for s in stops]
    schema = "fit int, number int, row bigint, label int, sums array<bigint>"
    grown = _in_parts(rows, width, tops, parts, ends, most).mapInArrow(_held_shares, schema)
    sums = {(c, s): _prefix_sum(c, s) for c in counts for s in range(len(stops))}
    total = grown.groupBy("fit", "row", "label").agg(*[e.alias(f"_{c}_{s}") for (c, s), e in sums.items()])
    stacked = [
        F.struct(F.lit(s).alias("stop"), F.lit(c).alias("trees"), (F.col(f"_{c}_{s}") / (SHARE_UNIT * c)).alias("score"))
        for c, s in sums
    ]
    return total.select("fit", "row", "label", F.inline(F.array(*stacked))).select(
        "fit", "stop", "trees", "row", "label", "score"
    )


def _prefix_sum(count: int, stop: int) -> Column:
    return F.sum(F.when(F.col("number") < count, F.get("sums", F.lit(stop))).otherwise(0))


def forest_scores(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    id_col: str,
    label: str,
    weight: str | None = None,
    trees: int = 100,
    rule: Rule | None = None,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """(label, score, prediction) of the test rows by a forest of the train rows."""
    edges = bin_edges(train, features)
    both = train.withColumn("_fold", F.lit(1)).unionByName(test.withColumn("_fold", F.lit(0)), True)
    rows = materialize(binned_rows(both, features, edges, id_col, label, weight, "_fold"))
    fits = [(0, rule or rule_of(len(features)))]
    scored = held_out_scores(rows, len(features), fits, [Stop()], [trees], seed)
    return scored.select("label", "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


# fixed values: the sizes that are tried
FULL_GRID = {
    "trees": [100, 200, 300],
    "max_depth": [10, 20, None],
    "min_split": [2, 5, 10],
    "min_leaf": [1, 2, 4],
}


def grid_scores(
    rows: DataFrame,
    width: int,
    folds: int,
    grid: dict[str, list] | None = None,
    seed: int = DEFAULTS.seed,
    local_rows: int = TREE_ROWS,
) -> DataFrame:
    """(fold, min_leaf, max_depth, min_split, trees, label, score) for every combination of the grid.

    One forest per fold and least leaf size is grown; all others are read off it.
    """
    grid = {**FULL_GRID, **(grid or {})}
    stops = [Stop(d, m) for d, m in product(grid["max_depth"], grid["min_split"])]
    fits = [(fold, rule_of(width, leaf)) for leaf in grid["min_leaf"] for fold in range(folds)]
    found = held_out_scores(rows, width, fits, stops, grid["trees"], seed, local_rows)

    def named(values: list, at: Column) -> Column:
        return F.get(F.array(*[F.lit(v).cast("int") for v in values]), at)

    leaves = [leaf for leaf in grid["min_leaf"] for _ in range(folds)]
    return found.select(
        (F.col("fit") % folds).alias("fold"),
        named(leaves, F.col("fit")).alias("min_leaf"),
        named([s.max_depth for s in stops], F.col("stop")).alias("max_depth"),
        named([s.min_split for s in stops], F.col("stop")).alias("min_split"),
        "trees",
        "label",
        "score",
    )


GRID_KEYS = ["trees", "max_depth", "min_split", "min_leaf"]


def grid_search(
    train: DataFrame,
    features: list[str],
    id_col: str,
    label: str,
    weight: str | None,
    folds: int = DEFAULTS.cv_folds,
    grid: dict[str, list] | None = None,
) -> DataFrame:
    """Every combination with the mean and deviation of its AUC over the folds, best first.

    ``train`` has a column ``fold``; max_depth is NULL where there is none.
    """
    rows = materialize(
        binned_rows(train, features, bin_edges(train, features), id_col, label, weight, "fold")
    )
    scored = materialize(grid_scores(rows, len(features), folds, grid))
    each = auc_by(scored, ["fold", *GRID_KEYS], "label", "score", None)
    mean = each.groupBy(*GRID_KEYS).agg(
        F.round(F.avg("auc"), 9).alias("mean_auc"), F.round(F.stddev_pop("auc"), 9).alias("std_auc")
    )
    return best_first(materialize(mean))


def best_first(search: DataFrame) -> DataFrame:
    deep = F.col("max_depth").asc_nulls_last()
    return search.orderBy(F.col("mean_auc").desc(), "trees", deep, "min_split", "min_leaf")


def best_rule(search: DataFrame, width: int) -> tuple[int, Rule]:
    """Number of trees and rule of the best combination."""
    best = search.first()
    return best["trees"], rule_of(width, best["min_leaf"], best["max_depth"], best["min_split"])


# --- a stored forest


@dataclass
class Forest:
    """Nodes of a fitted forest as a table; it is never held whole by the driver or one task."""

    features: list[str]
    edges: list[np.ndarray]
    trees: int
    nodes: DataFrame

    def by_slices(self, df: DataFrame, id_col: str, work, schema: str) -> DataFrame:
        """Cogroups slices of trees with blocks of rows: ``work(trees, rows)`` sees one of each.

        A slice is some trees with ``NODES_PER_SLICE`` nodes or fewer, and there are as many as keep
        all cores busy; a block has about ``ROWS_PER_BLOCK`` rows.  ``work`` returns arrays in the order
        of ``schema``.
        """
        n_nodes, n_rows = self.nodes.count(), df.count()
        cores = df.sparkSession.sparkContext.defaultParallelism
        slices = min(max(-(-n_nodes // NODES_PER_SLICE), 2 * cores), self.trees)
        blocks = max(-(-n_rows // ROWS_PER_BLOCK), 1)
        rows = binned_rows(df.withColumn("_none", F.lit(0)), self.features, self.edges, id_col, "_none")
        rows = rows.select("*", F.pmod("row", F.lit(blocks)).cast("int").alias("block"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        nodes = self.nodes.select(
            "*",
            (F.col("tree") % slices).cast("int").alias("slice"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        )
        empty = empty_table(schema)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return empty
            names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
            trees = trees_of([np.asarray(left.column(c)) for c in names])
            return work([nodes for _, nodes in trees], Rows.of(right))

        pair = nodes.groupBy("slice", "block").cogroup(rows.groupBy("slice", "block"))
        return pair.applyInArrow(run, schema)

    def in_pairs(self, df: DataFrame, id_col: str, function: Callable[..., Column], specification: bytes) -> DataFrame:
        """What a Java function makes of slices of packed trees and blocks of packed rows, a task a pair.

        There are as many slices as keep all cores busy, and more where trees are large; a block has about
        ``ROWS_PER_PAIR`` rows.
        """
        n_nodes, n_rows = self.nodes.count(), df.count()
        cores = df.sparkSession.sparkContext.defaultParallelism
        slices = min(max(-(-n_nodes // NODES_PER_PAIR), 4 * cores), self.trees)
        blocks = max(-(-n_rows // ROWS_PER_PAIR), 1)
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

        def packed_trees(batch: pa.Table) -> pa.Table:
            trees = trees_of([np.asarray(batch.column(c)) for c in names])
            packed = [(number % slices, jvm.packed_tree(nodes)) for number, nodes in trees]
            columns = [pa.array([p for p, _ in packed], pa.int32()), pa.array([b for _, b in packed], pa.binary())]
            return pa.Table.from_arrays(columns, names=["part", "block"])

        trees = self.nodes.groupBy("tree").applyInArrow(packed_trees, jvm.BLOCK_SCHEMA)
        rows = binned_rows(df.withColumn("_none", F.lit(0)), self.features, self.edges, id_col, "_none")

        def deal(data: Rows) -> Iterator[tuple[int, Rows]]:
            block = data.row % blocks
            for b in np.unique(block):
                yield int(b), data.take(np.flatnonzero(block == b))

        return jvm.over_pairs(function, specification, trees, jvm.blocks_of_parts(rows, blocks, deal), slices, blocks)

    def scores(self, df: DataFrame, id_col: str) -> DataFrame:
        """(row, score): mean class 1 share of the trees' leaves; row is the hash of the id."""

        def work(trees: list[Nodes], rows: Rows) -> pa.Table:
            total = sum(stopped_shares(t, rows.x, 0, [Stop()])[0] for t in trees)
            return pa.table({"row": rows.row, "total": np.asarray(total, np.int64)})

        parts = self.by_slices(df, id_col, work, "row bigint, total bigint")
        return parts.groupBy("row").agg((F.sum("total") / (SHARE_UNIT * self.trees)).alias("score"))


def fit_forest(
    train: DataFrame,
    features: list[str],
    id_col: str,
    label: str,
    weight: str | None = None,
    trees: int = 100,
    rule: Rule | None = None,
    seed: int = DEFAULTS.seed,
    local_rows: int = TREE_ROWS,
) -> Forest:
    """A forest of all rows of ``train``, stored."""
    edges = bin_edges(train, features)
    rows = materialize(binned_rows(train, features, edges, id_col, label, weight))
    fits = [(0, rule or rule_of(len(features)))]
    planted = _trees(fits, trees, seed)
    per_part = trees_a_part([trees], 1, train.sparkSession.sparkContext.defaultParallelism)
    tops, parts = tops_and_parts(rows, len(features), planted, Bootstrap(), rows.count(), per_part, local_rows)
    grown = _in_parts(rows, len(features), tops, parts, None, trees).mapInArrow(_grown_nodes, NODE_SCHEMA)
    above = top_rows(tops)
    if above:
        grown = grown.union(train.sparkSession.createDataFrame(above, NODE_SCHEMA))
    return Forest(features, edges, trees, materialize(grown))


def save_forest(forest: Forest, path: str) -> None:
    """Nodes as one table, names and cuts as another."""
    forest.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    cuts = [(i, f, [float(v) for v in e], forest.trees) for i, (f, e) in enumerate(zip(forest.features, forest.edges))]
    schema = "place int, feature string, cuts array<double>, trees int"
    forest.nodes.sparkSession.createDataFrame(cuts, schema).write.mode("overwrite").parquet(f"{path}/inputs")


def load_forest(spark, path: str) -> Forest:
    inputs = spark.read.parquet(f"{path}/inputs").orderBy("place").collect()
    edges = [np.array(r["cuts"], float) for r in inputs]
    return Forest([r["feature"] for r in inputs], edges, inputs[0]["trees"], spark.read.parquet(f"{path}/nodes"))
