"""Alignment of two tokenizers over a corpus: groups of tokens between shared ends, and linked id pairs.

Both tokenizers cut the same bytes.  Offsets where both end a token are found by divide and conquer:
from the middle token end of an interval outwards, ends are looked up by bisection among the other
tokenizer's ends; the first that both share splits the interval and both halves are searched in turn.
An interval without a shared end is a leaf and makes one group.  All open intervals of a batch of
texts take a step at once, and an end is looked up once only, so the work is linear in the tokens
times a bisection whatever the texts look like.

Two tokens are linked if their byte ranges overlap, so every stretch between neighbouring ends of
either tokenizer is one link.  A pair of ids is counted over the whole corpus.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import ship, small_batches
from tillwise.session import materialize

TOKENIZERS = "/opt/tokenizers"  # a folder that every executor has
BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
FREQUENT_SHARE = 1 / 200_000  # pairs above this share of all links are looked up from memory
BATCH_BYTES = 1_000_000
LONG_TEXT = 150_000  # characters

# The words a byte-level vocabulary was learned on, and its letters for bytes.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def _byte_of_letter() -> dict[str, int]:
    hidden = [b for b in range(256) if b not in _SHOWN]
    return {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Ids and bytes of a byte-level vocabulary in a tokenizer.json; special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters = _byte_of_letter()
        self.bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for token, number in spec["model"]["vocab"].items():
            if token not in special:
                self.bytes[number] = bytes(letters[c] for c in token)
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.fast = self._ranked()

    def _ranked(self):
        """The same vocabulary by rank, several times faster; none where ids do not follow the merges."""
        import tiktoken

        ranks = {token: number for number, token in enumerate(self.bytes) if token}
        if any(len(t) == 1 for t in self.bytes[256:]):
            return None
        return tiktoken.Encoding("ranked", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> np.ndarray:
        # a very long run of spaces is too deep for the fast way's word pattern
        if self.fast and len(text) < LONG_TEXT:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Ids and bytes of a sentencepiece model; it puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


class Table:
    """Bytes, lengths and decimal ids of a vocabulary, ready for lookup by id."""

    def __init__(self, coder):
        self.coder = coder
        self.length = np.array([len(t) for t in coder.bytes], np.int64)
        names = [str(i) for i in range(len(coder.bytes))]
        self.inner = np.array([n + "," for n in names], object)
        self.last = {end: np.array([n + end for n in names], object) for end in "|;"}

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.coder.bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def _tables(folder: str, a: str, b: str) -> tuple[Table, Table]:
    return Table(ByteLevel(f"{folder}/{a}")), Table(Pieces(f"{folder}/{b}"))


def shared_cuts(
    a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ascending ends ``a`` and ``b`` occur on both sides, a flag for each end.

    Text i has the tokens ``at_a[i]:at_a[i + 1]`` and ``at_b[i]:at_b[i + 1]``, one at least, and both
    sides end with it.
    """
    cut_a, cut_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    cut_a[at_a[1:] - 1] = True
    cut_b[at_b[1:] - 1] = True
    lo, hi = at_a[:-1], at_a[1:] - 1  # candidates, without the closing end
    keep = lo < hi
    lo, hi = lo[keep], hi[keep]
    step = np.zeros(len(lo), np.int64)
    while len(lo):
        middle = (lo + hi) // 2
        spot = np.where(step % 2, middle + (step + 1) // 2, middle - step // 2)
        inside = (spot >= lo) & (spot < hi)
        value = a[np.where(inside, spot, lo)]
        at = np.searchsorted(b, value)
        found = inside & (b[np.minimum(at, len(b) - 1)] == value)
        cut_a[spot[found]] = True
        cut_b[at[found]] = True
        # everything looked at around the middle is settled: the halves lie outside of it
        odd = step % 2 == 1
        left_end = middle - step // 2
        right_start = middle + 1 + np.where(odd, (step + 1) // 2, step // 2)
        lo2 = np.concatenate([lo[found], right_start[found]])
        hi2 = np.concatenate([left_end[found], hi[found]])
        more = ~found & (step + 1 < 2 * np.maximum(hi - middle, middle - lo + 1))
        lo = np.concatenate([lo2, lo[more]])
        hi = np.concatenate([hi2, hi[more]])
        step = np.concatenate([np.zeros(len(lo2), np.int64), step[more] + 1])
        keep = lo < hi
        lo, hi, step = lo[keep], hi[keep], step[keep]
    return cut_a, cut_b


def _flat(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end and the offset of each text."""
    at = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(i) for i in ids], out=at[1:])
    return np.concatenate(ids).astype(np.int64), at


def links_of(
    a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of both sides whose ranges overlap: each stretch between neighbouring ends is a link."""
    ends = np.concatenate([a, b[~cut_b]])
    order = np.argsort(ends, kind="stable")  # two ascending runs
    in_a = order < len(a)
    in_b = ~in_a
    in_b[in_a] = cut_a
    return np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b


def align_texts(texts: list[str | None], a: Table, b: Table) -> dict[str, pa.Array]:
    """Counts, digest and linked id pairs of each text; see ``alignment``."""
    use = [i for i, t in enumerate(texts) if t]
    ids_a = a.coder.encode([" " + texts[i] for i in use])
    ids_b = b.coder.encode([texts[i] for i in use])
    whole = []
    for k, i in enumerate(use):
        raw = b" " + texts[i].encode()
        if a.joined(ids_a[k]) == raw and b.joined(ids_b[k]) == raw:
            whole.append(k)
    use, ids_a, ids_b = [use[k] for k in whole], [ids_a[k] for k in whole], [ids_b[k] for k in whole]
    n = len(texts)
    counts = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    digests = [""] * n
    owners = pairs = times = np.zeros(0, np.int64)
    if use:
        (ids_a, at_a), (ids_b, at_b) = _flat(ids_a), _flat(ids_b)
        ends_a, ends_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
        cut_a, cut_b = shared_cuts(ends_a, ends_b, at_a, at_b)
        group_a = np.cumsum(cut_a) - cut_a
        group_b = np.cumsum(cut_b) - cut_b
        # the groups as text: tokens of a, then those of b, group after group
        until_a = np.cumsum(np.bincount(group_a))
        until_b = np.cumsum(np.bincount(group_b))
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], until_b])[group_a]
        place_b = np.arange(len(ids_b)) + until_a[group_b]
        shown = np.empty(len(ids_a) + len(ids_b), object)
        shown[place_a] = np.where(cut_a, a.last["|"][ids_a], a.inner[ids_a])
        shown[place_b] = np.where(cut_b, b.last[";"][ids_b], b.inner[ids_b])
        shown = shown.tolist()
        at = at_a + at_b
        for k, i in enumerate(use):
            text = "".join(shown[at[k] : at[k + 1]])[:-1]
            digests[i] = hashlib.sha256(text.encode()).hexdigest()
        n_groups = np.add.reduceat(cut_a.astype(np.int64), at_a[:-1])
        counts["n_a"][use], counts["n_b"][use] = np.diff(at_a), np.diff(at_b)
        counts["n_groups"][use] = n_groups
        n_links = np.diff(at) - n_groups
        counts["n_links"][use] = n_links
        owner = np.repeat(np.arange(len(use)), n_links)
        token_a, token_b = links_of(ends_a, ends_b, cut_a, cut_b)
        span = len(a.length) * len(b.length)
        key = np.sort(owner * span + ids_a[token_a] * len(b.length) + ids_b[token_b])
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(start, len(key)))
        owners, pairs = np.array(use)[key[start] // span], key[start] % span
    offsets = np.searchsorted(owners, np.arange(n + 1)).astype(np.int32)
    linked = pa.StructArray.from_arrays(
        [pa.array(pairs, pa.int64()), pa.array(times, pa.int32())], names=["pair", "times"]
    )
    return {c: pa.array(v) for c, v in counts.items()} | {
        "groups_sha256": pa.array(digests, pa.string()),
        "pairs": pa.ListArray.from_arrays(pa.array(offsets), linked),
    }


_OUT = (
    "_row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint,"
    " groups_sha256 string, pairs array<struct<pair:bigint,times:int>>"
)


def _aligner(folder: str, a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_a, table_b = _tables(folder, a, b)
        for part in small_batches(batches, BATCH_BYTES):
            found = align_texts(part.column("text").to_pylist(), table_a, table_b)
            yield pa.RecordBatch.from_pydict(
                {"_row": part.column("_row"), "doc_id": part.column("doc_id")} | found
            )

    return run


def aligned_texts(
    docs: DataFrame, folder: str = TOKENIZERS, a: str = BYTE_LEVEL, b: str = PIECES
) -> DataFrame:
    """Per row of ``docs``: _row, doc_id, the counts, the digest and the linked id pairs with times.

    A pair is the id of ``a`` times the vocabulary of ``b`` plus the id of ``b``.
    """
    ship(docs.sparkSession)
    slim = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    )
    return slim.mapInArrow(_aligner(folder, a, b), _OUT)


def pair_counts(texts: DataFrame, vocabulary_b: int) -> DataFrame:
    """(pair, links, best): how many links hold a pair, and whether none with its b id has more."""
    each = texts.select(F.inline("pairs")).groupBy("pair").agg(F.sum("times").alias("links"))
    each = materialize(each)
    b = F.col("pair") % vocabulary_b
    top = each.groupBy(b.alias("b")).agg(F.max("links").alias("top"))
    joined = each.withColumn("b", b).join(top, "b")
    return materialize(joined.select("pair", "links", (F.col("links") == F.col("top")).alias("best")))


def _looked_up(frequent):
    """Sums over the pairs found in memory, and the other pairs as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = frequent.value
        for part in batches:
            lists = part.column("pairs")
            inner = lists.flatten()
            rows = np.asarray(pc.list_parent_indices(lists))
            here, times = np.asarray(inner.field(0)), np.asarray(inner.field(1)).astype(np.int64)
            spot = np.minimum(np.searchsorted(pair, here), max(len(pair) - 1, 0))
            known = pair[spot] == here if len(pair) else np.zeros(len(here), bool)
            sums = np.zeros((2, part.num_rows), np.int64)
            np.add.at(sums[0], rows[known], times[known] * best[spot[known]])
            np.add.at(sums[1], rows[known], times[known] * links[spot[known]])
            at = np.searchsorted(rows[~known], np.arange(part.num_rows + 1)).astype(np.int32)
            rest = pa.StructArray.from_arrays(
                [pa.array(here[~known]), pa.array(times[~known].astype(np.int32))], names=["pair", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_row"),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.ListArray.from_arrays(pa.array(at), rest),
                ],
                names=["_row", "n_best", "count_sum", "pairs"],
            )

    return run


def alignment(
    docs: DataFrame,
    folder: str = TOKENIZERS,
    a: str = BYTE_LEVEL,
    b: str = PIECES,
    frequent_share: float = FREQUENT_SHARE,
) -> DataFrame:
    """Per row of ``docs``: token, group and link counts, the digest of its groups, sums over its links.

    ``n_best`` counts links whose pair has the most links of all pairs with the same b id, ties
    included; ``count_sum`` adds up the links of each link's pair over the corpus.  Texts that are
    null or empty, or that either tokenizer does not give back byte for byte, have no tokens: zeros
    and an empty digest.  Repeated rows are rows of their own and count each time; doc_id may be null
    or repeat; other columns are left aside.

    Pairs with more than ``frequent_share`` of all links, of which there are at most its inverse, are
    looked up in memory; the others, none of which is hot by definition, meet their counts by a join.
    """
    spark = docs.sparkSession
    texts = materialize(aligned_texts(docs, folder, a, b))
    counts = pair_counts(texts, Pieces(f"{folder}/{b}").model.get_piece_size())
    total = counts.agg(F.coalesce(F.sum("links"), F.lit(0))).scalar()
    rare = F.col("links") <= total * frequent_share
    top = counts.filter(~rare).orderBy("pair").toArrow()
    arrays = tuple(top.column(c).to_numpy() for c in ("pair", "links", "best"))
    found = texts.select("_row", "pairs").mapInArrow(
        _looked_up(spark.sparkContext.broadcast(arrays)),
        "_row bigint, n_best bigint, count_sum bigint, pairs array<struct<pair:bigint,times:int>>",
    )
    found = materialize(found)
    others = found.select("_row", F.inline("pairs")).join(counts.filter(rare), "pair")
    others = others.select(
        "_row",
        F.when(F.col("best"), F.col("times").cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("n_best"),
        (F.col("times") * F.col("links")).alias("count_sum"),
    )
    sums = found.select("_row", "n_best", "count_sum").union(others).groupBy("_row")
    sums = sums.agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.drop("pairs").join(sums, "_row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
