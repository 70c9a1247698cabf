"""Second-order boosting over binned rows, several fits at once.

A round grows one tree a fit from sums of gradients and hessians per node, feature and bin (see
``trees``), in a task or, with more rows, by one aggregation a level; leaves take a Newton step.  Gradients are whole numbers of 2**-30, so sums, and with them
splits and leaves, do not depend on how the rows are spread.  All fits of a cross validation take their
round together.  The model is bounded by its parameters; margins of all rows are written every
``ROUNDS_A_WRITE`` rounds and followed through the trees since then in between.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.ml.trees import (
    LOCAL_ROWS,
    ROW_SCHEMA,
    Nodes,
    Part,
    Rows,
    Rule,
    Tree,
    bin_edges,
    binned_rows,
    grow_everywhere,
    row_blocks,
    scramble,
    top_nodes,
)
from tillwise.session import materialize

UNIT = 2.0**30
ROUNDS_A_WRITE = 10
_MARGIN_SCHEMA = f"{ROW_SCHEMA}, margin array<double>"
NODE_SCHEMA = (
    "tree bigint, top bigint, id bigint, feature bigint, bin bigint, left bigint, right bigint,"
    " n bigint, a bigint, b bigint"
)


@dataclass(frozen=True)
class Boosting:
    """``second_order`` splits by gradients over hessians plus ``l2``; otherwise by mean residuals,
    with leaves that take the same step, starting from the log odds of the labels."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    l2: float = 1.0
    least_hessian: float = 1.0
    second_order: bool = True

    def rule(self) -> Rule:
        if self.second_order:
            return Rule(
                "newton",
                self.depth,
                l2=self.l2 * UNIT,
                least_child=self.least_hessian * UNIT,
                least_gain=1e-6 * UNIT,
            )
        return Rule("residual", self.depth, least_gain=1e-9 * UNIT * UNIT)

    def values(self, nodes: Nodes) -> np.ndarray:
        """The step of every node, times the learning rate."""
        steps = nodes.b + (self.l2 * UNIT if self.second_order else 0.0)
        return self.rate * nodes.a / np.maximum(steps, 1.0)


# fixed values: the two boosted models of the benchmark
GRADIENT = Boosting(depth=3, rate=0.1, second_order=False)
SECOND_ORDER = Boosting()


@dataclass
class Steps:
    """Trees of each fit with their values; ``added`` is what they add to a row's margin."""

    trees: list[list[tuple[Nodes, np.ndarray]]]

    def added(self, fit: int, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for nodes, value in self.trees[fit]:
            out += value[nodes.leaf(x, np.zeros(len(x), np.int64))]
        return out


@dataclass
class Gradients:
    """Channels of a row: 1, gradient and hessian of the log loss, in units."""

    since: Steps

    def __call__(self, tree: Tree, rows: Rows):
        index = np.flatnonzero(rows.fold != tree.fold)
        rows = rows.take(index)
        margin = rows.margin[:, tree.number] + self.since.added(tree.number, rows.x)
        p = 1.0 / (1.0 + np.exp(-margin))
        pull = np.rint(rows.weight * (rows.label - p) * UNIT).astype(np.int64)
        bend = np.rint(rows.weight * p * (1.0 - p) * UNIT).astype(np.int64)
        return index, np.ones(len(index), np.int64), pull, bend


def node_rows(some: list[Tree], part: Part, nodes: Nodes, _: Rows) -> pa.RecordBatch | None:
    """``NODE_SCHEMA`` rows of a finished part.

    The root of a part has the id -(node + 1) of the tree top it continues, other nodes count up from
    the part's own range.
    """
    if part.done:
        return None  # the tree top holds it
    owner = np.zeros(len(nodes.feature), np.int64)
    here = np.arange(len(some))
    owner[here] = here
    while len(here):
        here = here[nodes.feature[here] >= 0]
        for side in (nodes.left, nodes.right):
            owner[side[here]] = owner[here]
        here = np.concatenate([nodes.left[here], nodes.right[here]])
    name = np.arange(len(owner)) + (part.node << 32)
    name[: len(some)] = -(part.node + 1)
    child = [np.where(c >= 0, c + (part.node << 32), 0) for c in (nodes.left, nodes.right)]
    numbers = np.array([t.number for t in some])
    columns = [numbers[owner], np.full(len(owner), part.node), name, nodes.feature, nodes.bin, *child]
    columns += [nodes.n, nodes.a, nodes.b]
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def top_rows(tops: dict[int, tuple[Tree, Nodes]]) -> list[tuple]:
    """``NODE_SCHEMA`` rows of the tree tops; leaves that a part continues are left to it."""
    out = []
    for number, (_, nodes) in tops.items():
        for i, f in enumerate(nodes.feature):
            if f >= 0 or nodes.n[i]:
                sums = (int(nodes.n[i]), int(nodes.a[i]), int(nodes.b[i]))
                child = (-int(nodes.left[i]) - 1, -int(nodes.right[i]) - 1) if f >= 0 else (0, 0)
                out.append((number, i, -i - 1, int(f), int(nodes.bin[i]), *child, *sums))
    return out


def trees_of(columns: list[np.ndarray]) -> list[tuple[int, Nodes]]:
    """Number and nodes of each tree, the root first, from columns as in ``NODE_SCHEMA``."""
    columns = [np.asarray(c, np.int64) for c in columns]
    order = np.lexsort([columns[2], columns[2] != -1, columns[0]])
    columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.diff(columns[0], prepend=columns[0][0] - 1))
    found = []
    for lo, hi in zip(starts, [*starts[1:], len(columns[0])], strict=True):
        number, _, name, feature, cut, left, right, *sums = [c[lo:hi] for c in columns]
        child = [np.where(feature >= 0, np.searchsorted(name[1:], c) + 1, -1) for c in (left, right)]
        none = np.zeros(hi - lo, np.int64)
        found.append((int(number[0]), Nodes(feature, cut, *child, *sums, none, none.astype(np.uint64))))
    return found


def _followed(since: Steps):
    """Rows with the steps added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = Rows.of(b)
            fits = range(len(since.trees))
            margin = rows.margin + np.stack([since.added(f, rows.x) for f in fits], 1)
            at = np.arange(b.num_rows + 1, dtype=np.int32) * len(since.trees)
            stored = pa.ListArray.from_arrays(pa.array(at), pa.array(margin.ravel()))
            yield b.set_column(b.schema.names.index("margin"), "margin", stored)

    return run


@dataclass
class Boosted:
    """Fitted trees of each fit, and the binned rows with their final margins."""

    how: Boosting
    folds: list[int]
    start: list[float]
    rows: DataFrame
    trees: list[list[tuple[Nodes, np.ndarray]]] = field(default_factory=list)

    def held_out(self) -> DataFrame:
        """(fold, row, label, score) of the rows that the fit of their fold did not learn from."""
        wanted = F.array(*[F.lit(f) for f in self.folds])
        margin = F.get("margin", F.array_position(wanted, F.col("fold")).cast("int") - 1)
        score = F.lit(1.0) / (1 + F.exp(-margin))
        return self.rows.filter(F.col("fold").isin(self.folds)).select("fold", "row", "label", score.alias("score"))


def boost(
    rows: DataFrame,
    width: int,
    folds: list[int],
    how: Boosting = SECOND_ORDER,
    local_rows: int = LOCAL_ROWS,
) -> Boosted:
    """One fit per entry of ``folds``, each without the rows of its fold; ``rows`` is stored."""
    learnt = [F.count_if(F.col("fold") != f).alias(f"n{i}") for i, f in enumerate(folds)]
    ones = [F.count_if((F.col("fold") != f) & (F.col("label") == 1)).alias(f"p{i}") for i, f in enumerate(folds)]
    size = rows.agg(F.count("*").alias("n"), *learnt, *ones).first()
    start = [0.0] * len(folds)
    if not how.second_order:
        for i in range(len(folds)):
            positive, negative = size[f"p{i}"], size[f"n{i}"] - size[f"p{i}"]
            start[i] = float(np.log(positive / negative)) if positive and negative else 0.0
    top_down = size["n"] > local_rows
    if top_down:  # every level is an aggregation: a share of the rows for each core
        rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "row")
    stored = rows.withColumn("margin", F.array(*[F.lit(s) for s in start]))
    stored = materialize(stored) if top_down else stored
    blocks = row_blocks(stored) if top_down else None
    since, fitted = Steps([[] for _ in folds]), Boosted(how, folds, start, rows, [[] for _ in folds])
    for number in range(how.rounds):
        seeds = scramble(np.arange(len(folds)) + (number << 20))
        trees = [Tree(i, int(seeds[i]), f, how.rule()) for i, f in enumerate(folds)]
        if top_down:
            tops = top_nodes(blocks, width, trees, Gradients(since), 0, keep=True)
            found = [(fit, nodes) for fit, (_, nodes) in tops.items() if nodes.n[0]]
        else:
            grown, _ = grow_everywhere(
                stored, width, trees, Gradients(since), node_rows, NODE_SCHEMA, size["n"], 1, local_rows
            )
            grown = grown.toPandas()  # bounded: depth and fits
            found = trees_of([grown[c] for c in grown.columns]) if len(grown) else []
        for fit, tree in found:
            for listed in (since.trees, fitted.trees):
                listed[fit].append((tree, how.values(tree)))
        if (number + 1) % ROUNDS_A_WRITE == 0 or number + 1 == how.rounds:
            stored = materialize(stored.mapInArrow(_followed(since), _MARGIN_SCHEMA))
            if top_down:
                blocks.unpersist()
                blocks = row_blocks(stored)
            since = Steps([[] for _ in folds])
    if top_down:
        blocks.unpersist()
    fitted.rows = stored
    return fitted


def boosted_scores(
    train: DataFrame,
    test: DataFrame,
    features: list[str],
    id_col: str,
    label: str,
    how: Boosting = SECOND_ORDER,
    weight: str | None = None,
) -> DataFrame:
    """(label, score, prediction) of the test rows by a fit on the train rows; cuts come from these."""
    edges = bin_edges(train, features)
    both = train.withColumn("_fold", F.lit(1)).unionByName(test.withColumn("_fold", F.lit(0)), True)
    rows = materialize(binned_rows(both, features, edges, id_col, label, weight, "_fold"))
    scored = boost(rows, len(features), [0], how).held_out()
    return scored.select("label", "score", (F.col("score") > 0.5).cast("int").alias("prediction"))
