"""Ranked lexical search with per-term geometric blocking, exact.

The documents' counts of the asked terms are written once as a forward table, which also gives the
corpus statistics.  Tasks read it in segments.  In a segment the posting list of a term is clustered
by the likeness of its documents: a random projection of their score vectors, nearest of evenly spaced
members.  A cluster is a block; its summary holds, for every term that still counts, the largest score
any of its documents has there, rounded up.

Terms are taken rarest first.  A document with a term that was taken before is already decided, so
what a block can still bring a query is the sum of its summary over the query's terms not yet taken.
A block is skipped only if that sum is below the score of the query's k-th best so far, and a list is
not even clustered if the sum of its terms' largest scores is below that for every query.  All other
documents are scored exactly, in whole numbers, so the result is that of scoring every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.common import Words, cut_words, ship, small_batches, text_bytes
from tillwise.session import materialize

TOP = 10
BLOCK_DOCS = 32  # mean size of a block
CELLS = 4_000_000  # documents of a segment times terms asked for
DIMENSIONS = 16
ITEMS_PER_PASS = 512
ITEM_BYTES_PER_PASS = 1_000_000

_NO_TERM = np.ones(256, dtype=bool)
_NO_TERM[48:58] = _NO_TERM[65:91] = _NO_TERM[97:123] = _NO_TERM[128:] = False


def batch_terms(column: pa.Array) -> Words:
    """Terms of every text: runs of ASCII letters, digits and all characters beyond ASCII."""
    return cut_words(*text_bytes(column), _NO_TERM)


@dataclass
class Query:
    key: int
    terms: np.ndarray  # places of its distinct terms in the vocabulary


@dataclass
class Ranking:
    """What the tasks need: the queries, term weights and the corpus statistics."""

    queries: list[Query]
    weights: np.ndarray
    docs: int
    length: int
    top: int


def term_weight(docs: int, df: int) -> int:
    return floor(1000 * log((2 * docs + 2) / (2 * df + 1)))


def term_scores(rank: Ranking, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Score of each (term, document) occurrence; ``n`` is the document's number of terms."""
    m = 10 + (90 * n * rank.docs) // rank.length
    return rank.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _forward(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = vocabulary.value
        for part in small_batches(batches):
            words = batch_terms(part.column("text"))
            n = np.diff(words.at)
            hashes = words.hashes()
            spot = np.minimum(np.searchsorted(asked, hashes), len(asked) - 1)
            hit = asked[spot] == hashes if len(asked) else np.zeros(len(hashes), bool)
            owner = np.repeat(np.arange(len(n)), n)[hit]
            key, tf = np.unique(owner * max(len(asked), 1) + spot[hit], return_counts=True)
            at = np.searchsorted(key, np.arange(len(n) + 1) * max(len(asked), 1)).astype(np.int32)
            cells = pa.StructArray.from_arrays(
                [pa.array(key % max(len(asked), 1), pa.int32()), pa.array(tf, pa.int64())], names=["t", "tf"]
            )
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), cells)],
                names=["doc_id", "n", "cells"],
            )

    return run


class Best:
    """The best documents of one query so far."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this one cannot enter."""
        return max(int(self.score[-1]), 1) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.least
        score, doc = np.concatenate([self.score, score[good]]), np.concatenate([self.doc, doc[good]])
        order = np.lexsort([doc, -score])[: self.top]
        self.score, self.doc = score[order], doc[order]


def cluster(points: np.ndarray, size: int = BLOCK_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which clusters stand together, and where each starts."""
    k = -(-len(points) // size)
    if k <= 1:
        return np.arange(len(points)), np.zeros(1, np.int64)
    centres = points[(np.arange(k) * len(points)) // k]
    nearest = np.argmax(points @ centres.T, axis=1)
    order = np.argsort(nearest, kind="stable")
    return order, np.flatnonzero(np.diff(nearest[order], prepend=-1))


class Segment:
    """Scores of some documents for all asked terms, and the blocks of each term's list."""

    def __init__(self, rank: Ranking, doc: np.ndarray, scores: np.ndarray):
        self.doc, self.scores = doc, scores
        self.unit = max(-(-int(scores.max(initial=0)) // 65535), 1)
        self.ceiling = (-(-scores // self.unit)).astype(np.uint16)
        mix = np.random.default_rng(17).standard_normal((scores.shape[1], DIMENSIONS), dtype=np.float32)
        points = self.ceiling.astype(np.float32) @ mix
        self.points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        self.highest = self.ceiling.max(axis=0, initial=0).astype(np.int64)

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that hold the term, block after block, and where each block starts."""
        rows = np.flatnonzero(self.scores[:, term])
        order, start = cluster(self.points[rows])
        return rows[order], start

    def summaries(self, rows: np.ndarray, start: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Coordinatewise maximum of each block over ``terms``."""
        return np.maximum.reduceat(self.ceiling[np.ix_(rows, terms)], start, axis=0)


def search_segment(rank: Ranking, seg: Segment, best: list[Best], order: np.ndarray, holders: list) -> int:
    """Updates ``best`` with the segment's documents; returns how many were scored.

    ``order`` lists the terms rarest first, ``holders[t]`` the queries that ask for term t.
    """
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    seen = np.zeros((len(rank.queries), len(seg.doc)), bool)
    scored = 0
    for term in order:
        if not seg.highest[term]:
            continue
        open_, rest = [], []
        for q in holders[term]:
            left = rank.queries[q].terms
            left = left[place[left] >= place[term]]
            if seg.highest[left].sum() * seg.unit >= best[q].least:
                open_.append(q)
                rest.append(left)
        if not open_:
            continue
        rows, start = seg.blocks(term)
        coords = np.unique(np.concatenate(rest))
        summary = seg.summaries(rows, start, coords).astype(np.float32)
        chosen = np.zeros((len(coords), len(open_)), np.float32)
        for j, left in enumerate(rest):
            chosen[np.searchsorted(coords, left), j] = 1
        bounds = summary @ chosen  # whole numbers below 2**24
        size = np.diff(np.append(start, len(rows)))
        for j, q in enumerate(open_):
            alive = bounds[:, j].astype(np.int64) * seg.unit >= best[q].least
            if not alive.any():
                continue
            docs = rows[np.repeat(alive, size)]
            docs = docs[~seen[q, docs]]
            seen[q, docs] = True
            scored += len(docs)
            score = seg.scores[np.ix_(docs, rank.queries[q].terms)].sum(axis=1)
            best[q].add(score, seg.doc[docs])
    return scored


def _segments(batches: Iterator[pa.RecordBatch], rank: Ranking) -> Iterator[Segment]:
    terms = len(rank.weights)
    most = max(CELLS // max(terms, 1), 1)
    for part in batches:
        for first in range(0, part.num_rows, most):
            b = part.slice(first, most)
            lists = b.column("cells")
            cells = lists.flatten()
            rows = np.asarray(pa.compute.list_parent_indices(lists))
            t, tf = np.asarray(cells.field(0)), np.asarray(cells.field(1))
            n = np.asarray(b.column("n"))
            scores = np.zeros((b.num_rows, terms), np.int64)
            scores[rows, t] = term_scores(rank, t, tf, n[rows])
            yield Segment(rank, np.asarray(b.column("doc_id")), scores)


def _ranker(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = broadcast.value
        best = [Best(rank.top) for _ in rank.queries]
        order = np.argsort(-rank.weights, kind="stable")
        holders: list[list[int]] = [[] for _ in rank.weights]
        for q, query in enumerate(rank.queries):
            for t in query.terms:
                holders[t].append(q)
        for seg in _segments(batches, rank):
            search_segment(rank, seg, best, order, holders)
        keys = np.repeat([q.key for q in rank.queries], [len(b.score) for b in best])
        if len(keys):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array(np.concatenate([b.doc for b in best])),
                    pa.array(np.concatenate([b.score for b in best])),
                ],
                names=["_key", "doc_id", "score"],
            )

    return run


NO_ID = np.iinfo(np.int64).max


def _item_blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """(item_id, text) lists of bounded number and size, in the order of item_id."""
    ids, texts, size = [], [], 0
    rows = items.select("item_id", "text").filter("item_id IS NOT NULL").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"] or "")
        if len(ids) == ITEMS_PER_PASS or size >= ITEM_BYTES_PER_PASS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _block_hits(docs: DataFrame, ids: list[int], texts: list[str | None], top: int) -> DataFrame:
    """The best documents of each item of one block, from every task."""
    spark = docs.sparkSession
    words = batch_terms(pa.array(texts, pa.string()))
    hashes = words.hashes()
    vocabulary, place = np.unique(hashes, return_inverse=True)
    queries = [
        Query(key, np.unique(place[words.at[i] : words.at[i + 1]])) for i, key in enumerate(ids)
    ]
    cells = "doc_id bigint, n bigint, cells array<struct<t:int,tf:bigint>>"
    forward = materialize(docs.mapInArrow(_forward(spark.sparkContext.broadcast(vocabulary)), cells))
    forward = forward.filter("n > 0")
    size = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(vocabulary), np.int64)  # one row a term of the block
    for r in forward.select(F.inline("cells")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weights = np.array([term_weight(size["docs"], int(d)) for d in df], np.int64)
    rank = Ranking(queries, weights, size["docs"], size["length"], top)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = forward.filter(F.size("cells") > 0).repartition(tasks)
    return held.mapInArrow(
        _ranker(spark.sparkContext.broadcast(rank)), "_key bigint, doc_id bigint, score bigint"
    )


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of highest score for each item.

    Scores are above 0; equal scores rank by doc_id, a null doc_id last.  A null text has no terms;
    a document without terms does not count in the statistics, an item without terms finds nothing.
    Rows without item_id are no items; of repeated items one counts, and two texts of one item_id are
    searched together as one item.  Repeated documents are ranked each on their own.  Other columns are
    left aside.

    Items are the stated query set: they go over all documents in blocks of bounded size.  What a task
    holds is one segment of ``CELLS`` scores; what it sends on is ``top`` rows an item.
    """
    spark = docs.sparkSession
    ship(spark)
    one_each = items.groupBy("item_id").agg(
        F.concat_ws(" ", F.array_sort(F.collect_set("text"))).alias("text")
    )
    slim = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(int(NO_ID))).alias("doc_id"), "text")
    found = None
    for ids, texts in _item_blocks(one_each):
        part = _block_hits(slim, ids, texts, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("_key").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select(
        F.col("_key").alias("item_id"), "rank", F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "score"
    )


# The same rows in DuckDB's SQL, by scoring every document.
_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    r" 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
size AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT c.r, c.doc_id, c.term,
    CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
      * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))) AS score
  FROM c JOIN f USING (term) CROSS JOIN size),
h AS (SELECT item_id, r, doc_id, sum(score)::BIGINT AS score FROM s JOIN i USING (term) GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM h WHERE score > 0)
WHERE rank <= 10
"""
