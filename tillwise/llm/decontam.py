"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents are long, so the Jaccard similarity of an item and a whole
document says nothing.  Items are therefore partitioned by size into powers of two, and for an item
size class documents are seen as windows of four times the smallest item: two neighbouring blocks of
the class's largest size, so an item lies whole within at least one window.  Against such a window
an item that is contained to 0.8 has a Jaccard similarity near 0.2 or more, and one of ``HASHES``
MinHash values agrees but with probability 1e-6.  Each agreement is a candidate, and each candidate
is verified by the exact share of the item's shingles found in the whole document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import SHINGLE, SIMILARITY, batch_words, ship, shingle_hashes, small_batches
from tillwise.session import materialize

HASHES = 64
ITEMS_PER_PASS = 4096
ITEM_BYTES_PER_PASS = 8_000_000
SMALLEST_CLASS = 0  # one shingle

_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)

Block = list[tuple[int, np.ndarray]]


def size_class(n: int) -> int:
    """Exponent of the least power of two that holds ``n`` shingles."""
    return max(SMALLEST_CLASS, int(n - 1).bit_length())


def _values(hashes: np.ndarray, j: int) -> np.ndarray:
    """Value of hash function ``j`` for each shingle."""
    return (hashes >> np.uint64(32)).astype(np.uint32) * _MUL[j] + _ADD[j]


class ItemIndex:
    """MinHash values and exact shingle sets of one block of items."""

    def __init__(self, items: Block):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sets = [np.unique(s) for _, s in items]
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        by_class = defaultdict(list)
        for place, s in enumerate(self.sets):
            by_class[size_class(len(s))].append(place)
        for c, places in by_class.items():
            tables = []
            for j in range(HASHES):
                low = np.array([_values(self.sets[p], j).min() for p in places], np.uint32)
                order = np.argsort(low, kind="stable")
                tables.append((low[order], np.array(places)[order]))
            self.classes[c] = tables


def _window_minima(values: np.ndarray, at: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of every window of every text, and the text of each window.

    Blocks hold 2**c shingles and never cross a text; a window is a block and the next one.
    """
    n = np.diff(at)
    blocks = -(-n // (1 << c))
    owner = np.repeat(np.arange(len(n)), blocks)
    first = np.cumsum(blocks) - blocks
    start = np.repeat(at[:-1], blocks) + ((np.arange(len(owner)) - np.repeat(first, blocks)) << c)
    low = np.minimum.reduceat(values, start)
    joined = low.copy()
    same = owner[1:] == owner[:-1]
    joined[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
    return joined, owner


def candidates(index: ItemIndex, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct (text, place of item) pairs in which a window and an item share a MinHash value."""
    found = []
    if len(hashes):
        for j in range(HASHES):
            values = _values(hashes, j)
            for c, tables in index.classes.items():
                low, places = tables[j]
                window, owner = _window_minima(values, at, c)
                left = np.searchsorted(low, window)
                hit = np.flatnonzero(low[np.minimum(left, len(low) - 1)] == window)
                if len(hit):
                    right = np.searchsorted(low, window[hit], "right")
                    n = right - left[hit]
                    which = np.repeat(left[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append(np.unique(np.stack([np.repeat(owner[hit], n), places[which]], 1), axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _search(broadcast, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(broadcast.value)
        for b in small_batches(batches):
            hashes, at = shingle_hashes(batch_words(b.column("text")))
            rows = []
            ids = b.column("doc_id")
            last, own = -1, None
            for text, place in candidates(index, hashes, at):
                if text != last:
                    last, own = text, np.unique(hashes[at[text] : at[text + 1]])
                item = index.sets[place]
                spot = np.minimum(np.searchsorted(own, item), len(own) - 1)
                shared = int((own[spot] == item).sum())
                if shared >= threshold * len(item) - 1e-9:
                    rows.append((ids[int(text)].as_py(), int(index.ids[place]), shared, len(item)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in cols],
                    names=["doc_id", "item_id", "shared", "item_shingles"],
                )

    return run


def _item_blocks(benchmark: DataFrame) -> Iterator[Block]:
    """Items with their shingles, in blocks of bounded number and size, in the order of item_id."""
    rows = benchmark.select("item_id", "text").filter("item_id IS NOT NULL").distinct()
    block: Block = []
    size = 0
    for r in rows.orderBy("item_id").toLocalIterator():
        hashes, _ = shingle_hashes(batch_words(pa.array([r["text"]], pa.string())))
        if not len(hashes):
            continue
        block.append((r["item_id"], hashes))
        size += hashes.nbytes
        if len(block) == ITEMS_PER_PASS or size >= ITEM_BYTES_PER_PASS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY
) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): documents that hold ``threshold`` of an item.

    ``shared`` of ``item_shingles`` distinct runs of five words of the item occur in the document.
    Words are cut at ASCII white space and compared with A-Z in lower case; null is empty.  Items or
    documents of fewer than five words have no shingles and match nothing; rows without item_id are
    no items.  Repeated rows of a doc_id give repeated results, repeated items do not.  The items
    are the stated query set: they go over all documents in blocks of bounded size, one pass a
    block, so a document never leaves its task and a passage that a third of them hold is spread as
    the documents are.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "doc_id bigint, item_id bigint, shared bigint, item_shingles bigint"
    slim = docs.select("doc_id", "text")
    found = None
    for block in _item_blocks(benchmark):
        part = slim.mapInArrow(_search(spark.sparkContext.broadcast(block), threshold), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` without documents that hold a benchmark item; all their columns.

    Rows of one doc_id go together; rows without doc_id are judged each on its own.
    """
    ids = contaminated(docs, benchmark, threshold).select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(ids, "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.filter("doc_id IS NULL")
    if nameless.isEmpty():
        return named
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = materialize(nameless.select(whole, F.monotonically_increasing_id().alias("doc_id"), "text"))
    bad = contaminated(rows, benchmark, threshold).select("doc_id").distinct()
    return named.unionByName(rows.join(bad, "doc_id", "left_anti").select("doc.*"))


# The same rows in DuckDB's SQL, by joining all shingles.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT r, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS s FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY 1)
SELECT ds.doc_id, s.item_id, count(*) AS shared, n.item_shingles
FROM s JOIN ds USING (s) JOIN n USING (item_id)
GROUP BY ds.r, ds.doc_id, s.item_id, n.item_shingles
HAVING count(*) >= 0.8 * n.item_shingles - 1e-9
"""
