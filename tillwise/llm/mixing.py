"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are laid into blocks, one of which is read a slot.  With target shares w that
add up to 1, block j of a source may not start before slot floor(j / w) and must be done by slot
ceil((j + 1) / w).  Earliest deadline first meets all of these, so after every slot the number of blocks
taken from a source differs from its target by less than one.  Shares are taken as the exact fractions
they are; nothing is rounded to a common grain.  When a source ends, time runs faster for those that are
left, whose blocks keep their releases and deadlines.

The schedule is as long as there are blocks.  A corpus has ``SLOTS`` blocks at most, and one more a
source: blocks are longer where there are more rows, so the schedule is made at once and its size does
not grow with the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.llm.links import join_checked
from tillwise.session import materialize

BLOCK_ROWS = 64
SLOTS = 200_000
BUCKET_ROWS = 20_000
_TICKS = 1 << 100  # parts of a slot in which releases and deadlines are told apart


def shares(weights: dict[str, float]) -> dict[str, Fraction]:
    """Exact shares that add up to 1."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w / total for s, w in exact.items()}


def schedule(blocks: dict[str, int], weights: dict[str, Fraction]) -> Iterator[tuple[str, int]]:
    """(source, block) of every slot: earliest deadline first among the released blocks.

    Ties go to the source that comes first in name.
    """

    def ticks(n: int, w: Fraction) -> int:
        return n * _TICKS * w.denominator // w.numerator

    waiting = [(0, s, 0) for s in sorted(blocks) if blocks[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    open_ = sum((weights[s] for s in blocks if blocks[s]), Fraction(0))
    begun, since = 0, 0  # time at which the open sources last changed, and slots since
    while waiting or ready:
        now = begun + ticks(since + 1, open_)  # the end of this slot
        while waiting and (waiting[0][0] < now or not ready):
            release, s, j = heapq.heappop(waiting)
            if release >= now and ready:
                heapq.heappush(waiting, (release, s, j))
                break
            heapq.heappush(ready, (ticks(j + 1, weights[s]), s, j))
        _, s, j = heapq.heappop(ready)
        yield s, j
        since += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (ticks(j + 1, weights[s]), s, j + 1))
        else:
            begun, since = begun + ticks(since, open_), 0
            open_ -= weights[s]


def _numbered(docs: DataFrame, source: str) -> DataFrame:
    """(doc, source, id, rank): rank is the place of each row within its source from 0 on.

    Rows are dealt into hash ranges of about BUCKET_ROWS rows, and a range of a source is numbered by
    a window of its own, after the numbers of rows in the ranges before it; a source with a third of
    all rows is many small windows.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
        F.col("doc_id").alias("id"),
        F.xxhash64(F.lit("mix"), "doc_id").alias("hash"),
    )
    n = max(1, -(-docs.count() // BUCKET_ROWS))
    rows = rows.withColumn("range", F.pmod(F.shiftrightunsigned("hash", 1), F.lit(n)))
    sizes = rows.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "range").orderBy("hash", "id")
    return (
        rows.withColumn("row", F.row_number().over(inside) - 1)
        .join(sizes, ["source", "range"])
        .select("doc", "source", (F.col("before") + F.col("row")).alias("rank"))
    )


def target_weights(sizes: dict[str, int], given: dict[str, float] | None, power: float) -> dict[str, Fraction]:
    """Shares of all sources: by the given weights, or else by rows ** ``power``."""
    if given:
        rest = min(given.values())
        return shares({s: given.get(s, rest) for s in sizes})
    return shares({s: n**power for s, n in sizes.items()})


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source: str = "source",
    block_rows: int = BLOCK_ROWS,
    power: float = 0.5,
) -> DataFrame:
    """``docs`` with mix_block, mix_slot and mix_position: the order in which to read them.

    ``weights`` are shares of blocks by source (others get the least of them); without, a source
    weighs as the square root (``power``) of its rows, so small sources come earlier and the large
    one does not crowd them out.  All rows are kept: when a source ends, the others go on by their
    weights.  ``mix_slot`` numbers the blocks, ``mix_block`` those of the own source, and
    ``mix_position`` the rows without gaps.  A block has ``block_rows`` rows, more if there would be
    over ``SLOTS`` blocks; a source's last block may be shorter.  Within a source, rows are in the order
    of a hash of doc_id, so its blocks are random samples of it.  A null source is a source of its own
    (empty name); rows that repeat a doc_id stay next to each other.  The three added names replace
    columns of these names; all other columns come through, whatever their names.

    The driver sees one count per source and the schedule, whose size is bounded.
    """
    added = ["mix_block", "mix_slot", "mix_position"]
    docs = docs.drop(*added)
    spark = docs.sparkSession
    ranked = materialize(_numbered(docs, source))
    sizes = {r["source"]: r["n"] for r in ranked.groupBy("source").agg(F.count("*").alias("n")).collect()}
    rows = max(block_rows, -(-sum(sizes.values()) // SLOTS))
    blocks = {s: -(-n // rows) for s, n in sizes.items()}
    places, start = [], 0
    for slot, (s, j) in enumerate(schedule(blocks, target_weights(sizes, weights, power) if sizes else {})):
        places.append((s, j, slot, start))
        start += min(rows, sizes[s] - j * rows)
    names = ["source", "mix_block", "mix_slot", "start"]
    plan = pd.DataFrame(places, columns=names)
    schema = "source string, mix_block bigint, mix_slot bigint, start bigint"
    plan = materialize(spark.createDataFrame(plan, schema) if places else spark.createDataFrame([], schema))
    block = F.floor(F.col("rank") / rows).cast("bigint")
    out = join_checked(ranked.withColumn("mix_block", block), plan, ["source", "mix_block"])
    position = (F.col("start") + F.col("rank") % rows).cast("bigint").alias("mix_position")
    return out.select("doc.*", "mix_block", "mix_slot", position)
