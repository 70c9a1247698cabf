"""Join of documents on the Jaccard similarity of their word shingles, with Bayesian pruning.

MinHash values in bands propose pairs.  The values of a pair are then compared a few at a time; with
an even prior, n comparisons of which m agree leave the similarity distributed as
Beta(m + 1, n - m + 1), and the pair is dropped as soon as the probability of reaching the threshold
falls below a tolerance.  The first comparison is of one bit of ``BITS`` further values, which a
member carries into its bucket.  Pairs that pass it are never rows: a bucket ties its close members into
families, whose members meet in tasks that compare the rest of the values and then the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import (
    SIMILARITY,
    batch_words,
    connected_groups,
    mix,
    ship,
    shingle_hashes,
    small_batches,
)
from tillwise.llm.links import close_families, join_checked, settled
from tillwise.session import materialize

BANDS, ROWS = 40, 5  # a pair at 0.8 shares no band with probability 1e-7
HASHES = BANDS * ROWS
STEP = 20  # MinHash values compared at a time
BITS = 64  # one-bit values compared within buckets
TOLERANCE = 1e-5
CHUNK_DOCS, CHUNK_BYTES = 200, 4_000_000
SMALL_MATRIX = 4_096  # pairs whose MinHash values are compared a step at once

_rng = np.random.default_rng(13)
_MUL = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BIT = _rng.integers(0, 1 << 32, BITS, dtype=np.uint32) | np.uint32(1)
_BAND = mix(_rng.integers(1, 1 << 62, ROWS, dtype=np.uint64)) | np.uint64(1)


def minhash(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values (texts x HASHES) of texts that all have shingles."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, HASHES), np.uint32)
    for j in range(HASHES):
        out[:, j] = np.minimum.reduceat(h * _MUL[j] + _ADD[j], at[:-1])
    return out


def one_bits(values: np.ndarray) -> np.ndarray:
    """A bit of the first ``BITS`` MinHash values of each text; it agrees by chance in half of all cases."""
    bits = (values[:, :BITS] * _BIT) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8), axis=1).view(">u8").ravel().astype(np.uint64)


def least_bit_matches(threshold: float, tolerance: float = TOLERANCE) -> int:
    """The fewest of ``BITS`` equal bits with which a pair stays.

    Bits agree with probability r = (1 + similarity) / 2, evenly spread over [1/2, 1] beforehand.
    """
    r = (np.arange(20_000) + 0.5) / 40_000 + 0.5
    for m in range(BITS + 1):
        weight = m * np.log(r) + (BITS - m) * np.log1p(-r)
        weight = np.exp(weight - weight.max())
        if weight[r >= (1 + threshold) / 2].sum() >= tolerance * weight.sum():
            return m
    return BITS


def least_matches(threshold: float, tolerance: float = TOLERANCE) -> list[int]:
    """For every number of comparisons the fewest matches with which a pair stays.

    P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identity of the words, number of shingles, bands and MinHash values of every text."""
    for b in small_batches(batches):
        w = batch_words(b.column("text"))
        size = np.diff(w.at)
        h = w.hashes()
        place = (np.arange(len(h)) - np.repeat(w.at[:-1], size)).astype(np.uint64)
        keys = []
        for salt in (1 << 42, 1 << 43):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + mix(place + np.uint64(salt))), dtype=np.uint64)])
            keys.append((total[w.at[1:]] - total[w.at[:-1]]).view(np.int64))
        shingles, at = shingle_hashes(w)
        n = np.diff(at)
        some = np.flatnonzero(n > 0)
        values = minhash(shingles, np.append(at[:-1][some], at[-1])) if len(some) else np.zeros((0, HASHES), np.uint32)
        bands = values.reshape(len(some), BANDS, ROWS).astype(np.uint64)
        bands = mix((bands * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        short = (values >> np.uint32(16)).astype("<u2")
        band_at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
        tags = np.zeros(len(n), np.uint64)
        tags[some] = one_bits(values)
        byte_at = np.concatenate([[0], np.cumsum(np.where(n > 0, HASHES * 2, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                *[pa.array(k) for k in keys],
                pa.array(size, pa.int64()),
                pa.array(tags.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(band_at), pa.array(bands.ravel().view(np.int64))),
                pa.BinaryArray.from_buffers(
                    pa.binary(), len(n), [None, pa.py_buffer(byte_at.tobytes()), pa.py_buffer(short.tobytes())]
                ),
            ],
            names=["doc_id", "k1", "k2", "n_words", "tag", "bands", "sig"],
        )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u2") for x in column.to_pylist()])


def _close(threshold: float):
    """Whether the bits that two members carry leave it likely enough that they are alike."""
    least = least_bit_matches(threshold)

    def close(tag: np.ndarray, n: np.ndarray, other_tag: np.ndarray, other_n: np.ndarray) -> np.ndarray:
        return BITS - np.bitwise_count((tag ^ other_tag).view(np.uint64)) >= least

    return close


def _shingle_sets(column: pa.Array) -> list[np.ndarray]:
    hashes, at = shingle_hashes(batch_words(column))
    return [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the given documents, stored."""
    ids = nodes.select(F.col("node").alias("doc_id"))
    found = join_checked(docs, ids, "doc_id").select(F.col("doc_id").alias("node"), "text")
    return materialize(found.dropDuplicates(["node"]))


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of ``left`` with ``right`` sets, by products of 0/1 matrices."""
    words, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = np.bincount(where, minlength=len(words)) > 1
    number = np.cumsum(common) - 1
    used = common[where]
    owner, where = owner[used], number[where[used]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    for lo in range(0, int(common.sum()), width):
        a, b = np.searchsorted(where, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[a:b], where[a:b] - lo] = 1
        total += m[left] @ m[right].T
    return total


def _likely(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of signatures the Bayesian pruning leaves, as a matrix."""
    alive = np.ones((len(left), len(right)), bool)
    matches = np.zeros(alive.shape, np.int16)
    for step, m in enumerate(least):
        part = slice(step * STEP, (step + 1) * STEP)
        if alive.size <= SMALL_MATRIX:
            matches += (left[:, None, part] == right[None, :, part]).sum(2, dtype=np.int16)
        else:
            for h in range(part.start, part.stop):
                matches += left[:, h][:, None] == right[:, h][None, :]
        alive &= matches >= m
        if not alive.any():
            break
    return alive


def _count_links(threshold: float):
    least = least_matches(threshold)

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        chunk = table.column("chunk").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        links, linked, mates = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64), nodes
        if len(left) and len(right):
            sig = _signatures(table.column("sig"))
            alive = _likely(sig[left], sig[right], least)
            if i == j:
                alive = np.triu(alive, 1)
            rows, cols = alive.any(1), alive.any(0)
            if rows.any():
                left, right, alive = left[rows], right[cols], alive[rows][:, cols]
                open_ = np.union1d(left, right)
                sets = _shingle_sets(table.column("text").take(pa.array(open_)).combine_chunks())
                size = np.array([len(s) for s in sets], np.float32)
                at, to = np.searchsorted(open_, left), np.searchsorted(open_, right)
                shared = shared_counts(sets, at, to)
                union = size[at][:, None] + size[to][None, :] - shared
                alive &= shared >= threshold * union - 1e-6
                links[left] += alive.sum(1)
                linked[left] += alive @ copies[right]
                np.add.at(links, right, alive.sum(0))
                np.add.at(linked, right, copies[left] @ alive)
                order = np.argsort(nodes)
                place = np.empty(len(nodes), np.int64)
                place[order] = np.arange(len(nodes))
                x, y = np.nonzero(alive)
                mates = nodes[order][settled(place[left[x]], place[right[y]], len(nodes))[place]]
        return pa.table({"node": nodes, "mate": mates, "links": links, "linked": linked})

    return run


def _link_numbers(docs: DataFrame, signed: DataFrame, families: DataFrame, threshold: float) -> DataFrame:
    """(node, mate, links, linked): linked texts and their documents, of the nodes of families.

    A family is cut into chunks of about 200 texts or 4 MB; every two chunks meet in a task of
    their own, which prunes and verifies their pairs, and sends on one row per text: its numbers of links
    there and the least node that a path of links leads to.  So no task and no row set grows with the pairs,
    only the number of tasks does.
    """
    texts = _texts(docs, families.select("node"))
    rows = families.join(texts, "node").join(signed.select("node", "sig", "copies"), "node")
    rows = materialize(rows)
    size = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_DOCS), F.ceil(F.col("bytes") / CHUNK_BYTES)).cast("int")
    rows = rows.join(size.select("root", chunks.alias("chunks")), "root")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    tasks = rows.withColumn("chunk", chunk).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    )
    tasks = tasks.select(
        "root", "node", "copies", "sig", "text", "chunk",
        F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
    )
    return tasks.groupBy("root", "i", "j").applyInArrow(
        _count_links(threshold), "node bigint, mate bigint, links bigint, linked bigint"
    )


def _grouped(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signed documents, their classes of equal words, numbers of links of the class heads, and their groups."""
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = (
        "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, tag bigint, bands array<bigint>, sig binary"
    )
    signed = materialize(slim.mapInArrow(_signed, schema))
    classes = (
        signed.filter("n_words > 0 AND doc_id IS NOT NULL")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    )
    classes = materialize(classes)
    heads = signed.filter(F.size("bands") > 0).join(
        classes.select(F.col("node").alias("doc_id"), "k1", "k2", "copies"), ["doc_id", "k1", "k2"]
    )
    heads = materialize(
        heads.select(F.col("doc_id").alias("node"), "copies", "tag", "n_words", "bands", "sig").dropDuplicates(["node"])
    )
    members = heads.select(F.explode("bands").alias("bucket"), "node", "tag", F.col("n_words").alias("n"))
    families = materialize(close_families(members, _close(threshold)))
    links = materialize(_link_numbers(slim, heads, families, threshold))
    groups = materialize(connected_groups(links, "node", "mate"))
    numbers = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    return signed, classes, numbers, groups


def jaccard_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_linked_docs, head_id, n_copies.

    Two texts are linked when the Jaccard similarity of their sets of five-word shingles is
    ``threshold`` or more (A-Z in lower case, words cut at ASCII white space).  ``class_id`` is the
    least doc_id of the connected group, ``n_links`` the number of different texts linked to this one
    and ``n_linked_docs`` the number of their documents.  Texts of the same words are copies: they
    share ``head_id``, the least of their ids, and ``n_copies``, and are compared once.  Texts of one
    to four words have no shingles, so they have copies but no links; a text without words (null,
    empty, blank) and a row without doc_id are alone.  doc_id is taken as unique; repeated rows count
    as copies.  A pair at exactly the threshold is missed with probability 1e-4 or less.
    """
    signed, classes, numbers, groups = _grouped(docs, threshold)
    placed = classes.join(groups, "node", "left").join(numbers, "node", "left")
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    placed = placed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    keys = signed.select("doc_id", "k1", "k2", "n_words").withColumn("_salt", spread)
    alone = (F.col("n_words") == 0) | F.col("doc_id").isNull()
    keys = keys.withColumn("k1", F.when(~alone, F.col("k1")))
    out = keys.join(placed, ["k1", "k2", "_salt"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "doc_id",
        F.coalesce("root", "node", "doc_id").alias("class_id"),
        F.coalesce("links", zero).alias("n_links"),
        F.coalesce("linked", zero).alias("n_linked_docs"),
        F.coalesce("node", "doc_id").alias("head_id"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"),
    )


def keep_one_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with the document of least doc_id of each group only; all their columns.

    Rows without doc_id and texts without words stay; rows that repeat a kept doc_id stay.
    """
    signed, classes, _, groups = _grouped(docs, threshold)
    last = classes.join(groups, "node", "left").filter(F.coalesce("root", "node") == F.col("node"))
    last = last.select("k1", "k2", F.col("node").alias("keep"))
    salted = last.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    keys = signed.filter("n_words > 0 AND doc_id IS NOT NULL").withColumn(
        "_salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    )
    kept = keys.join(salted, ["k1", "k2", "_salt"], "left")
    gone = kept.filter(F.col("keep").isNull() | (F.col("keep") != F.col("doc_id")))
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
