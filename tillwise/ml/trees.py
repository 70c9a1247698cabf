"""Decision trees over binned features, many at once, from the top in passes and to the end in tasks.

A node with more than ``LOCAL_ROWS`` rows is split by one aggregation a level: tasks add up its cells
(feature, bin), the sums meet in a shuffle, and the best split of a node is found from its own cells.
Once a node's rows fit a task they are shuffled by node and the subtree is grown to the end there, at
any depth.  Both ways add whole numbers and choose by the same function, so where the border lies
changes nothing in the trees.

Every tree has a key, every node the key of its path, and draws by chance are hashes of these and of
row numbers: a task that is run again does the same, and a shallower or earlier-stopped tree is a
truncation of the deep one.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BINS = 255
SKETCH_ACCURACY = 20_000
LOCAL_ROWS = 200_000
PAIRS_AT_ONCE = 300_000  # (row, tree) pairs grown together in a task
BLOCK_ROWS = 100_000
ROWS_IN_CACHE = 8_192  # rows that follow a tree together
OPEN_AT_ONCE = 512  # nodes of one aggregation
_WIDTH = 256

ROW_SCHEMA = "row bigint, label int, weight double, fold int, x array<smallint>"


# --- binned rows


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Ascending cut values per feature from one quantile sketch each, all in one pass.

    Values up to a cut go left.  The largest value is no cut.
    """
    shares = [i / bins for i in range(bins + 1)]
    found = df.agg(
        *[F.percentile_approx(F.col(f).cast("double"), shares, SKETCH_ACCURACY).alias(f) for f in features]
    ).first()
    return [np.unique(np.array(found[f] or [], float))[:-1] for f in features]


def binned_rows(
    df: DataFrame,
    features: list[str],
    edges: list[np.ndarray],
    id_col: str,
    label: str,
    weight: str | None = None,
    fold: str | None = None,
) -> DataFrame:
    """``ROW_SCHEMA`` rows: x holds the bin of each feature, row a hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.searchsorted(e, np.asarray(b.column(f))) for f, e in zip(features, edges, strict=True)]
            flat = np.stack(cols, 1).astype(np.int16).ravel()
            at = np.arange(b.num_rows + 1, dtype=np.int32) * len(features)
            x = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
            head = [b.column(c) for c in ("row", "label", "weight", "fold")]
            yield pa.RecordBatch.from_arrays([*head, x], names=["row", "label", "weight", "fold", "x"])

    slim = df.select(
        F.xxhash64(id_col).alias("row"),
        F.col(label).cast("int").alias("label"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
        *[F.col(f).cast("double").alias(f) for f in features],
    )
    return slim.mapInArrow(run, ROW_SCHEMA)


@dataclass
class Rows:
    """Columns of some binned rows."""

    row: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    x: np.ndarray
    margin: np.ndarray | None = None
    kept: dict[int, tuple] | None = None  # channels by number of the tree, see ``top_nodes``

    @classmethod
    def of(cls, data: pa.RecordBatch | pa.Table) -> Rows:
        def column(name):
            c = data.column(name)
            return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

        def matrix(name):
            flat = np.asarray(column(name).flatten())
            return flat.reshape(data.num_rows, len(flat) // max(data.num_rows, 1))

        plain = [np.asarray(column(c)) for c in ("row", "label", "weight", "fold")]
        margin = matrix("margin") if "margin" in data.schema.names else None
        return cls(*plain, matrix("x"), margin)

    def batch(self) -> pa.RecordBatch:
        def listed(matrix, kind):
            at = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
            return pa.ListArray.from_arrays(pa.array(at), pa.array(matrix.ravel(), kind))

        columns = {
            "row": pa.array(self.row, pa.int64()),
            "label": pa.array(self.label, pa.int32()),
            "weight": pa.array(self.weight, pa.float64()),
            "fold": pa.array(self.fold, pa.int32()),
            "x": listed(self.x, pa.int16()),
        }
        if self.margin is not None:
            columns["margin"] = listed(self.margin, pa.float64())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def take(self, index: np.ndarray) -> Rows:
        margin = None if self.margin is None else self.margin[index]
        return Rows(
            self.row[index], self.label[index], self.weight[index], self.fold[index], self.x[index], margin
        )


def scramble(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# --- trees


@dataclass(frozen=True)
class Rule:
    """When and how nodes split.

    ``kind``: "gini" with a, b as weights of the two classes; "newton" with a, b as sums of gradients
    and hessians; "residual" with a as a sum of residuals whose mean is fitted.  ``l2`` and
    ``least_child`` are in the units of b.
    """

    kind: str = "gini"
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features_per_split: int | None = None
    l2: float = 0.0
    least_child: float = 0.0
    least_gain: float = -np.inf

    def quality(self, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.astype(float), b.astype(float)
        if self.kind == "gini":
            return (a * a + b * b) / np.maximum(a + b, 1.0)
        if self.kind == "newton":
            return a * a / np.maximum(b + self.l2, 1.0)
        return a * a / np.maximum(n, 1)

    def may_split(self, n, a, b, depth) -> np.ndarray:
        open_ = n >= max(self.min_split, 2 * self.min_leaf)
        if self.max_depth is not None:
            open_ = open_ & (depth < self.max_depth)
        return open_ & (a > 0) & (b > 0) if self.kind == "gini" else open_


@dataclass
class Nodes:
    """Nodes of one or more trees; children come after their parent, -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    a: np.ndarray
    b: np.ndarray
    depth: np.ndarray
    key: np.ndarray

    @classmethod
    def roots(cls, key: np.ndarray, depth: np.ndarray) -> Nodes:
        none, zero = np.full(len(key), -1), np.zeros(len(key), np.int64)
        return cls(none, none.copy(), none.copy(), none.copy(), zero, zero.copy(), zero.copy(), depth, key)

    def add_children(self, parent: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> None:
        """Splits ``parent``; the new nodes stand at the end, left before right."""
        first = len(self.feature) + 2 * np.arange(len(parent))
        self.feature[parent], self.bin[parent] = feature, cut
        self.left[parent], self.right[parent] = first, first + 1
        key = scramble(np.repeat(self.key[parent], 2) + np.tile(np.array([1, 2], np.uint64), len(parent)))
        more = Nodes.roots(key, np.repeat(self.depth[parent] + 1, 2))
        for name in self.__dataclass_fields__:
            setattr(self, name, np.concatenate([getattr(self, name), getattr(more, name)]))

    def leaf(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to from its node ``at``, some rows at a time so that they stay in cache."""
        inner = self.feature >= 0
        feature, cut = np.where(inner, self.feature, 0), np.where(inner, self.bin, 1 << 15)
        here = np.arange(len(inner))
        child = np.stack([np.where(inner, c, here) for c in (self.left, self.right)], 1).ravel()
        out, flat, width = np.array(at, np.int64), np.ascontiguousarray(x).reshape(-1), x.shape[1]
        first = np.arange(min(len(out), ROWS_IN_CACHE)) * width
        for lo in range(0, len(out), ROWS_IN_CACHE):
            spot = out[lo : lo + ROWS_IN_CACHE]
            start = first[: len(spot)] + lo * width
            while inner.take(spot).any():
                right = flat.take(start + feature.take(spot)) > cut.take(spot)
                spot = child.take(2 * spot + right)
            out[lo : lo + ROWS_IN_CACHE] = spot
        return out


def cells_of(node: np.ndarray, x: np.ndarray, channels: tuple[np.ndarray, ...]):
    """Sums of the channels per (node, feature, bin); the key holds all three, ascending."""
    width = x.shape[1]
    key = ((node[:, None].astype(np.int64) * width + np.arange(width)) * _WIDTH + x).ravel()
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    rows = order // width
    return key[start], tuple(np.add.reduceat(c[rows], start) for c in channels)


@dataclass
class Cuts:
    """The best cut of each (node, feature) that has cells: its gain, bin and rows of the left child."""

    group: np.ndarray  # node * width + feature
    varied: np.ndarray  # whether the node has several bins of the feature
    gain: np.ndarray
    bin: np.ndarray
    n_left: np.ndarray


def best_cuts(key: np.ndarray, channels: tuple, rule: Rule) -> Cuts:
    """``key`` and ``channels`` are those of ``cells_of``."""
    group = key // _WIDTH
    new = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    of = np.cumsum(new) - 1
    left, whole = [], []
    for c in channels:
        total = np.cumsum(c)
        before = total[first] - c[first]
        left.append(total - before[of])
        whole.append((total[first + size - 1] - before)[of])
    right = [w - part for w, part in zip(whole, left, strict=True)]
    valid = (left[0] >= rule.min_leaf) & (right[0] >= rule.min_leaf) & (right[0] > 0)
    if rule.least_child:
        valid &= (left[2] >= rule.least_child) & (right[2] >= rule.least_child)
    gain = rule.quality(*left) + rule.quality(*right) - rule.quality(*whole)
    gain = np.where(valid & (gain > rule.least_gain), gain, -np.inf)
    top = np.maximum.reduceat(gain, first)
    place = np.where(gain == top[of], np.arange(len(key)), len(key))
    place = np.minimum.reduceat(place, first)
    return Cuts(group[first], size > 1, top, key[place] % _WIDTH, left[0][place])


def best_splits(key: np.ndarray, channels: tuple, width: int, node_key: np.ndarray, rule: Rule):
    """(node, feature, bin, rows of the left child) of every node that has a valid split.

    ``key`` and ``channels`` are those of ``cells_of``; ``node_key`` is indexed by node.
    """
    cuts = best_cuts(key, channels, rule)
    node, feature = cuts.group // width, cuts.group % width
    # the features a node looks at: the first ones in its own order that are not constant
    drawn = _drawn(node_key[node], feature, rule)
    varied = np.flatnonzero(cuts.varied)
    varied = varied[np.lexsort([drawn[varied], node[varied]])]
    at = node[varied]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    seen = varied[rank < (rule.features_per_split or width)]
    seen = seen[cuts.gain[seen] > -np.inf]
    order = np.lexsort([np.arange(len(seen)), -cuts.gain[seen], node[seen]])
    seen = seen[order]
    seen = seen[np.flatnonzero(np.diff(node[seen], prepend=-1))]
    return node[seen], feature[seen], cuts.bin[seen], cuts.n_left[seen]


def _drawn(node_key: np.ndarray, feature: np.ndarray, rule: Rule) -> np.ndarray:
    """Where a feature stands in the order of a node."""
    return scramble(node_key ^ scramble(feature + 1)) if rule.features_per_split else feature


def feature_cells(key: np.ndarray, size: int, sums: tuple) -> tuple[np.ndarray, tuple]:
    """Number of rows and sums per key, all below ``size``; by a table where keys are dense, else by sorting.

    ``sums`` are whole numbers below 2**53 in all, held as doubles.
    """
    if size <= 4 * len(key):
        n = np.bincount(key, minlength=size)
        some = np.flatnonzero(n)
        cells = [np.bincount(key, c, size)[some] for c in sums]
        return some, (n[some], *[c.astype(np.int64) for c in cells])
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    cells = [np.add.reduceat(c[order], start).astype(np.int64) for c in sums]
    return key[start], (np.diff(start, append=len(key)), *cells)


def _level_splits(x: np.ndarray, index: np.ndarray, local: np.ndarray, channels: tuple, keys: np.ndarray, rule: Rule):
    """What ``best_splits`` gives for rows ``index`` that stand node by node, one feature of a node at a time.

    A node is done when it has looked at as many features that vary as it may: the cells of all others
    are never added up.
    """
    nodes, width = len(keys), x.shape[1]
    order = np.argsort(_drawn(keys[:, None], np.arange(width)[None, :], rule) + np.zeros((nodes, 1), np.int64), axis=1)
    looked, gain = np.zeros(nodes, np.int64), np.full(nodes, -np.inf)
    feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
    flat, base = x.reshape(-1), index * width
    for rank in range(width):
        mine = order[:, rank]
        key = local * _WIDTH + flat[base + mine[local]]
        cuts = best_cuts(*feature_cells(key, nodes * _WIDTH, channels), rule)
        looked[cuts.group] += cuts.varied
        better = cuts.varied & (cuts.gain > gain[cuts.group])
        node = cuts.group[better]
        gain[node], cut[node], feature[node] = cuts.gain[better], cuts.bin[better], mine[node]
        if rank + 1 >= (rule.features_per_split or width):
            open_ = looked < (rule.features_per_split or width)
            keep = open_[local]
            if not keep.any():
                break
            if not keep.all():
                local, base, channels = local[keep], base[keep], tuple(c[keep] for c in channels)
    found = np.flatnonzero(feature >= 0)
    return found, feature[found], cut[found]


def grow(x: np.ndarray, unit: np.ndarray, channels: tuple, roots: Nodes, rule: Rule, index: np.ndarray | None = None) -> Nodes:
    """Grows every root to the end; ``unit`` is the root of each row, channels are n (of ones), a, b.

    ``index`` are the rows of ``x``, by default each of them once.  Rows stand node by node throughout.
    """
    nodes = replace(roots)
    index = np.arange(len(x)) if index is None else index
    channels = tuple(c.astype(float) for c in channels[1:])
    x = np.ascontiguousarray(x)
    at, lo = unit, 0
    if len(at) and (np.diff(at) < 0).any():
        order = np.argsort(at, kind="stable")
        at, index, channels = at[order], index[order], tuple(c[order] for c in channels)
    while lo < len(nodes.feature):
        hi = len(nodes.feature)
        local = at - lo
        sums = [np.bincount(local, minlength=hi - lo)]
        sums += [np.bincount(local, c, hi - lo).astype(np.int64) for c in channels]
        nodes.n[lo:hi], nodes.a[lo:hi], nodes.b[lo:hi] = sums
        open_ = rule.may_split(*sums, nodes.depth[lo:hi])
        keep = open_[local]
        if not keep.all():
            at, index, channels = at[keep], index[keep], tuple(c[keep] for c in channels)
        if len(at):
            some = np.flatnonzero(open_ & (sums[0] > 0))
            number = np.cumsum(open_ & (sums[0] > 0)) - 1
            node, feature, cut = _level_splits(x, index, number[at - lo], channels, nodes.key[lo:hi][some], rule)
            nodes.add_children(some[node] + lo, feature, cut)
            inner = nodes.feature[at] >= 0
            if not inner.all():
                at, index, channels = at[inner], index[inner], tuple(c[inner] for c in channels)
            right = x[index, nodes.feature[at]] > nodes.bin[at]
            at = np.where(right, nodes.right[at], nodes.left[at])
            order = _side_by_side(at, right)
            at, index, channels = at[order], index[order], tuple(c[order] for c in channels)
        lo = hi
    return nodes


def _side_by_side(child: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order that puts the rows of each left child before those of the right one; parents stand in order."""
    size = np.bincount(child - child.min()) if len(child) else np.zeros(1, np.int64)
    start = np.cumsum(size) - size
    place = np.empty(len(child), np.int64)
    for side in (~right, right):
        mine = np.flatnonzero(side)
        of = child[mine] - (child.min() if len(child) else 0)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        rank = np.arange(len(mine)) - np.repeat(first, np.diff(first, append=len(mine)))
        place[start[of] + rank] = mine
    return place


# --- trees over a cluster


@dataclass(frozen=True)
class Tree:
    """``fold`` is the fold that the tree does not learn from."""

    number: int
    key: int
    fold: int
    rule: Rule


Channels = Callable[[Tree, Rows], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@dataclass
class Part:
    """What one task grows: trees from their root, or one node of a single tree.

    ``done`` holds n, a, b of a node that cannot split although it has too many rows for a task: only
    held-out rows meet there, in several parts.
    """

    trees: list[Tree]
    node: int
    key: int | None = None
    depth: int = 0
    done: tuple[int, int, int] | None = None


def row_blocks(rows: DataFrame) -> RDD:
    """Packed ``Rows`` of a few batches each, kept where they were made for as many passes as follow."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK_ROWS:
                yield one(held)
                held = []
        if held:
            yield one(held)

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        data = Rows.of(pa.Table.from_batches(held))
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(data)], pa.binary())], names=["block"])

    packed = rows.mapInArrow(pack, "block binary").rdd.map(lambda r: bytes(r[0]))
    return packed.persist(StorageLevel.MEMORY_AND_DISK)


def _keeping(trees: list[Tree], channels: Channels) -> Callable[[Iterator[bytes]], Iterator[bytes]]:
    """Blocks with the channels of all trees."""

    def run(packed: Iterator[bytes]) -> Iterator[bytes]:
        for block in packed:
            data = pickle.loads(block)
            data.kept = {}
            for tree in trees:
                index, _, *sums = channels(tree, data)
                data.kept[tree.number] = (index.astype(np.int32), None, *sums)
            yield pickle.dumps(replace(data, margin=None))

    return run


def _kept(tree: Tree, rows: Rows) -> tuple:
    return rows.kept[tree.number]


def _open_cells(blocks: RDD, width: int, tops: dict, open_: list, channels: Channels) -> RDD:
    """(slot, sums of n, a, b by feature and bin) for each open (tree, node), added up by task."""
    size = width * _WIDTH

    def run(packed: Iterator[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        by_tree: dict[int, dict[int, int]] = {}
        for slot, (number, node) in enumerate(open_):
            by_tree.setdefault(number, {})[node] = slot
        table: dict[int, np.ndarray] = {}
        for block in packed:
            data = pickle.loads(block)
            for number, slots in by_tree.items():
                tree, nodes = tops[number]
                index, _, *sums = channels(tree, data)
                place_of = np.full(len(nodes.feature), -1)
                place_of[list(slots)] = np.arange(len(slots))
                x = data.x[index]
                place = place_of[nodes.leaf(x, np.zeros(len(x), np.int64))]
                hit = place >= 0
                if not hit.any():
                    continue
                x, sums, first = x[hit], [c[hit].astype(float) for c in sums], place[hit] * width
                if number not in table:
                    table[number] = np.zeros((3, len(slots) * size), np.int64)
                for f in range(width):
                    key, cells = feature_cells((first + f) * _WIDTH + x[:, f], len(slots) * size, sums)
                    table[number][:, key] += np.stack(cells)
        for number, cells in table.items():
            for i, slot in enumerate(by_tree[number].values()):
                mine = cells[:, i * size : (i + 1) * size]
                if mine[0].any():
                    yield slot, mine.copy()

    return blocks.mapPartitions(run).reduceByKey(np.add, min(len(open_), blocks.getNumPartitions()))


def _chooser(rules: list[Rule], keys: np.ndarray, depths: list[int], width: int):
    """The split of one node from its own cells, feature -1 if it has none, sums of its left child, and its own."""

    def choose(cells: tuple[int, np.ndarray]) -> tuple[int, int, int, list[int], list[int]]:
        slot, table = cells
        total = table[:, :_WIDTH].sum(axis=1).tolist()
        if rules[slot].may_split(*[np.array([t]) for t in total], depths[slot])[0]:
            some = np.flatnonzero(table[0])
            _, found, where, _ = best_splits(slot * width * _WIDTH + some, tuple(table[:, some]), width, keys, rules[slot])
            if len(found):
                feature, cut = int(found[0]), int(where[0])
                left = table[:, feature * _WIDTH : feature * _WIDTH + cut + 1].sum(axis=1).tolist()
                return slot, feature, cut, left, total
        return slot, -1, -1, [0, 0, 0], total

    return choose


def top_nodes(
    blocks: RDD, width: int, trees: list[Tree], channels: Channels, local_rows: int, keep: bool = False
) -> dict[int, tuple[Tree, Nodes]]:
    """Splits nodes of more than ``local_rows`` rows, one aggregation a level; the driver sees splits.

    ``blocks`` are those of ``row_blocks``.  A child that cannot split gets its sums from the split and
    is not looked at again.  With ``keep`` channels are worked out once and stored with the rows for all
    levels, which suits a few trees of many levels.
    """
    if keep:
        kept = blocks.mapPartitions(_keeping(trees, channels)).persist(StorageLevel.MEMORY_AND_DISK)
        tops = top_nodes(kept, width, trees, _kept, local_rows)
        kept.unpersist()
        return tops
    tops = {
        t.number: (t, Nodes.roots(np.array([t.key], np.uint64), np.zeros(1, np.int64))) for t in trees
    }
    waiting = [(t.number, 0) for t in trees]
    while waiting:
        open_, waiting = waiting[:OPEN_AT_ONCE], waiting[OPEN_AT_ONCE:]
        rules = [tops[number][0].rule for number, _ in open_]
        keys = np.array([tops[number][1].key[node] for number, node in open_], np.uint64)
        depths = [int(tops[number][1].depth[node]) for number, node in open_]

        cells = _open_cells(blocks, width, tops, open_, channels)
        found = cells.map(_chooser(rules, keys, depths, width)).collect()
        for slot, feature, cut, left, total in sorted(found, key=lambda r: r[0]):
            number, node = open_[slot]
            tree, nodes = tops[number]
            nodes.n[node], nodes.a[node], nodes.b[node] = total
            if feature < 0:
                continue
            nodes.add_children(np.array([node]), np.array([feature]), np.array([cut]))
            right = [t - part for t, part in zip(total, left, strict=True)]
            for child, sums in ((nodes.left[node], left), (nodes.right[node], right)):
                if sums[0] <= local_rows:
                    continue
                if tree.rule.may_split(*[np.array([v]) for v in sums], nodes.depth[child])[0]:
                    waiting.append((number, int(child)))
                else:
                    nodes.n[child], nodes.a[child], nodes.b[child] = sums
    return tops


def _parts(tops: dict[int, tuple[Tree, Nodes]], n_rows: int, per_part: int, per_task: int) -> list[Part]:
    parts, slices = [], {}
    for tree, nodes in tops.values():
        if len(nodes.feature) == 1 and not nodes.n[0]:
            slices.setdefault((tree.fold, tree.rule), []).append(tree)
        else:
            for node in np.flatnonzero(nodes.feature < 0):
                here = Part([tree], int(node), int(nodes.key[node]), int(nodes.depth[node]))
                if nodes.n[node]:  # looked at, and without a split
                    here.done = tuple(int(c[node]) for c in (nodes.n, nodes.a, nodes.b))
                parts += [here] * (-(-n_rows // per_task) if here.done else 1)
    for trees in slices.values():
        trees.sort(key=lambda t: t.number)
        for i in range(0, len(trees), per_part):
            parts.append(Part(trees[i : i + per_part], 0))
    return parts


def dealer(tops: dict, parts: list[Part], channels: Channels) -> Callable[[Rows], Iterator[tuple[int, Rows]]] | None:
    """Gives rows to the parts they belong to, held-out rows included; None if each part takes all rows."""
    if all(p.key is None for p in parts):
        return None
    at: dict[tuple[int, int], list[int]] = {}
    for i, p in enumerate(parts):
        if p.key is not None:
            at.setdefault((p.trees[0].number, p.node), []).append(i)
    whole = [i for i, p in enumerate(parts) if p.key is None]
    split = sorted({number for number, _ in at})

    def deal(data: Rows) -> Iterator[tuple[int, Rows]]:
        for i in whole:
            yield i, data
        for number in split:
            tree, nodes = tops[number]
            leaf = nodes.leaf(data.x, np.zeros(len(data.row), np.int64))
            first, count = np.zeros((2, len(nodes.feature)), np.int64)
            for node in np.flatnonzero(nodes.feature < 0):
                first[node], count[node] = at[(number, int(node))][0], len(at[(number, int(node))])
            used = np.zeros(len(leaf), bool)
            used[channels(tree, data)[0]] = True
            used &= nodes.n[leaf] == 0
            used |= data.fold == tree.fold
            shard = (scramble(data.row) % count[leaf].astype(np.uint64)).astype(np.int64)
            target = np.where(used, first[leaf] + shard, -1)
            for part in np.unique(target[used]):
                yield int(part), data.take(np.flatnonzero(target == part))

    return deal


def _dealt(rows: DataFrame, parts: int, deal: Callable[[Rows], Iterator[tuple[int, Rows]]] | None) -> DataFrame:
    """Rows with the parts they belong to."""
    if not deal:
        return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, mine in deal(Rows.of(b)):
                yield mine.batch().append_column("part", pa.array(np.full(len(mine.row), part, np.int32)))

    extra = ", margin array<double>" if "margin" in rows.columns else ""
    return rows.mapInArrow(run, f"{ROW_SCHEMA}{extra}, part int")


def tops_and_parts(
    rows: DataFrame, width: int, trees: list[Tree], channels: Channels, n_rows: int, per_part: int, local_rows: int
) -> tuple[dict[int, tuple[Tree, Nodes]], list[Part]]:
    """The tree tops, and the parts that continue them.

    A part holds at most ``local_rows`` rows, except where no split is left to make it smaller.
    """
    if n_rows > local_rows:
        blocks = row_blocks(rows)
        tops = top_nodes(blocks, width, trees, channels, local_rows)
        blocks.unpersist()
    else:
        tops = {t.number: (t, Nodes.roots(np.array([t.key], np.uint64), np.zeros(1, np.int64))) for t in trees}
    return tops, _parts(tops, n_rows, per_part, local_rows)


def grow_everywhere(
    rows: DataFrame,
    width: int,
    trees: list[Tree],
    channels: Channels,
    finish: Callable[[list[Tree], Part, Nodes, Rows], pa.RecordBatch | None],
    schema: str,
    n_rows: int,
    per_part: int = 25,
    local_rows: int = LOCAL_ROWS,
) -> tuple[DataFrame, dict[int, tuple[Tree, Nodes]]]:
    """Grows ``trees`` over ``rows`` and returns what ``finish`` makes of each part, and the tree tops.

    ``channels(tree, rows)`` gives the rows a tree learns from and their n, a, b.  ``finish`` gets the
    trees of a part, whose roots are the first nodes, the nodes and all rows of the part.
    """
    tops, parts = tops_and_parts(rows, width, trees, channels, n_rows, per_part, local_rows)
    deal = dealer(tops, parts, channels)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = parts[key[0].as_py()]
        data = Rows.of(table)
        out = []
        if part.done:
            leaf = Nodes.roots(np.array([part.key], np.uint64), np.full(1, part.depth))
            leaf.n[:], leaf.a[:], leaf.b[:] = part.done
            out.append(finish(part.trees, part, leaf, data))
        size = max(PAIRS_AT_ONCE // max(len(data.row), 1), 1)
        for i in range(0, 0 if part.done else len(part.trees), size):
            some = part.trees[i : i + size]
            taken = [channels(t, data) for t in some]
            unit = np.repeat(np.arange(len(some)), [len(t[0]) for t in taken])
            index = np.concatenate([t[0] for t in taken])
            sums = tuple(np.concatenate([t[c] for t in taken]) for c in (1, 2, 3))
            keys = [part.key if part.key is not None else t.key for t in some]
            roots = Nodes.roots(np.array(keys, np.uint64), np.full(len(some), part.depth))
            out.append(finish(some, part, grow(data.x, unit, sums, roots, some[0].rule, index), data))
        out = [b for b in out if b is not None]
        return pa.Table.from_batches(out, empty.schema) if out else empty

    empty = empty_table(schema)
    return _dealt(rows, len(parts), deal).groupBy("part").applyInArrow(run, schema), tops


def empty_table(schema: str) -> pa.Table:
    return pa.Table.from_batches([], to_arrow_schema(StructType.fromDDL(schema)))
