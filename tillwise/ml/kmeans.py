"""k-means with many starts and numbers of clusters in the same passes over the rows.

All centres of all fits are one block.  A pass finds every row's nearest centre in each fit by one
matrix product and sends on counts and sums per centre only, so seventy fits read the rows as often as
the slowest of them.  Starting centres are drawn with chances in proportion to the squared distance to
those drawn before (k-means++): each row draws an exponential waiting time divided by that distance,
and the least of all rows wins, one pass a centre.  A start's first k centres serve every k.

Coordinates are whole numbers of 2**-24, so sums do not depend on how the rows are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.ml.trees import scramble
from tillwise.session import ship_package

UNIT = 2.0**24
INERTIA_UNIT = 2.0**20


@dataclass
class Fit:
    k: int
    start: int
    centres: np.ndarray
    inertia: float = float("inf")
    moving: bool = True


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number coordinates and the hash of each row."""
    flat = np.asarray(batch.column("z").flatten())
    z = flat.reshape(batch.num_rows, len(flat) // max(batch.num_rows, 1))
    return np.rint(z * UNIT).astype(np.int64), np.asarray(batch.column("row"))


def _squares(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    z = q / UNIT
    return np.stack([((z - c) ** 2).sum(axis=1) for c in centres], 1)


def _pass(points: DataFrame, add_up: Callable, width: int, sums: str) -> list:
    """(group, place) sums of a task's rows, met in a shuffle; ``sums`` names the summed columns."""
    names = sums.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                found = add_up(*_points(b))
                total = found if total is None else total + found
        if total is not None:
            place = np.arange(len(total))
            cols = [pa.array(place), *[pa.array(total[:, i]) for i in range(len(names))]]
            yield pa.RecordBatch.from_arrays(cols, names=["place", *names])

    schema = "place bigint, " + ", ".join(f"{n} bigint" for n in names)
    parts = points.mapInArrow(run, schema).groupBy("place").agg(*[F.sum(n).alias(n) for n in names])
    return sorted(parts.collect())


def seeds(points: DataFrame, starts: list[int], most: int) -> dict[int, np.ndarray]:
    """``most`` starting centres for each start."""
    drawn: dict[int, list] = {s: [] for s in starts}
    for step in range(most):
        so_far = {s: np.array(c) for s, c in drawn.items()}

        def run(batches: Iterator[pa.RecordBatch], so_far=so_far, step=step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q, row = _points(b)
                for s, centres in so_far.items():
                    far = _squares(q, centres).min(axis=1) if len(centres) else np.ones(len(q))
                    lot = scramble(scramble(row) ^ scramble(np.uint64(s * 1000 + step)))
                    wait = -np.log(((lot >> np.uint64(11)) + 1.0) / (2.0**53 + 1.0))
                    wait = np.where(far > 0, wait / np.maximum(far, 1e-300), np.inf)
                    i = int(np.argmin(wait))
                    spot = pa.array([q[i].tolist()], pa.list_(pa.int64()))
                    cols = [pa.array([s], pa.int32()), pa.array([wait[i]]), spot]
                    yield pa.RecordBatch.from_arrays(cols, names=["start", "wait", "q"])

        found = points.mapInArrow(run, "start int, wait double, q array<bigint>").groupBy("start")
        for r in found.agg(F.min(F.struct("wait", "q")).alias("first")).collect():
            drawn[r["start"]].append(np.array(r["first"]["q"]) / UNIT)
    return {s: np.array(c) for s, c in drawn.items()}


def _one_pass(points: DataFrame, fits: list[Fit], width: int) -> list:
    """Per centre of all fits: rows, inertia and sums of coordinates."""
    blocks = [f.centres for f in fits]

    def add_up(q: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = []
        for centres in blocks:
            far = _squares(q, centres)
            near = far.argmin(axis=1)
            best = np.rint(far[np.arange(len(q)), near] * INERTIA_UNIT).astype(np.int64)
            own = np.zeros((len(centres), width + 2), np.int64)
            np.add.at(own, near, np.column_stack([np.ones(len(q), np.int64), best, q]))
            out.append(own)
        return np.concatenate(out)

    return _pass(points, add_up, width, "n inertia " + " ".join(f"s{i}" for i in range(width)))


def fit_all(
    points: DataFrame, ks: list[int], starts: list[int], max_iter: int = 300, tol: float = 1e-9
) -> list[Fit]:
    """A fit for every number of clusters and start; ``points`` holds z (array) and row, stored.

    A fit stops once its centres move by ``tol`` or less in all; a centre without rows stays.
    """
    ship_package(points.sparkSession)
    head = points.select(F.size("z")).first()
    if head is None:
        return []
    width = head[0]
    first = seeds(points, starts, max(ks))
    fits = [Fit(k, s, first[s][:k]) for k in ks for s in starts]
    for turn in range(max_iter + 1):
        open_ = [f for f in fits if f.moving]
        if not open_:
            break
        rows = _one_pass(points, open_, width)
        at = 0
        for f in open_:
            mine = np.array([r[1:] for r in rows[at : at + len(f.centres)]], float)
            at += len(f.centres)
            f.inertia = mine[:, 1].sum() / INERTIA_UNIT
            held = mine[:, 0] > 0
            moved = f.centres.copy()
            moved[held] = mine[held, 2:] / mine[held, :1] / UNIT
            if ((moved - f.centres) ** 2).sum() <= tol or turn == max_iter:
                f.moving = False
            else:
                f.centres = moved
    return fits


def best_of(fits: list[Fit]) -> dict[int, Fit]:
    """The start with the least inertia for each number of clusters."""
    return {k: min((f for f in fits if f.k == k), key=lambda f: (f.inertia, f.start)) for k in {f.k for f in fits}}


def silhouettes(points: DataFrame, fits: list[Fit]) -> list[float]:
    """Mean squared-Euclidean silhouette of each fit, all in two passes.

    The mean squared distance to a cluster follows from its size, mean and mean square.
    """
    width = fits[0].centres.shape[1]
    stats = _one_pass(points, fits, width)
    blocks, at = [], 0
    for f in fits:
        rows = np.array([r[1:] for r in stats[at : at + len(f.centres)]], float)
        at += len(f.centres)
        n = rows[:, 0]
        mean = rows[:, 2:] / np.maximum(n, 1)[:, None] / UNIT
        # inertia was taken about the centres the rows chose by; move it to the mean
        spread = rows[:, 1] / INERTIA_UNIT / np.maximum(n, 1) - ((mean - f.centres) ** 2).sum(axis=1)
        blocks.append((f.centres, n, mean, np.maximum(spread, 0)))

    def add_up(q: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = []
        for centres, n, mean, spread in blocks:
            near = _squares(q, centres).argmin(axis=1)
            far = _squares(q, mean) + spread
            far[:, n == 0] = np.inf
            rows, size = np.arange(len(q)), n[near]
            own = far[rows, near] * size / np.maximum(size - 1, 1)
            far[rows, near] = np.inf
            other = far.min(axis=1)
            score = np.where(size > 1, (other - own) / np.maximum(np.maximum(other, own), 1e-300), 0.0)
            out.append([len(q), int(np.rint(np.where(np.isfinite(other), score, 0.0) * 2.0**30).sum())])
        return np.array(out, np.int64)

    return [r["s"] / 2.0**30 / r["n"] for r in _pass(points, add_up, width, "n s")]
