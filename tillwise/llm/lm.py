"""Language-model scores: a log-bilinear network over word classes, trained by noise contrast.

Words are what ``[^\\x20\\x09-\\x0D]+`` finds after A-Z are lower-cased, and each text closes with one
end token.  The most frequent words are a class each; all others fall into classes by their last
letters, and within such a class a word has its smoothed share of the class's tokens.  So

    p(word | two words before) = p(class | classes of the two words before) * p(word | class)

The first factor is log-bilinear: the vectors of the two classes before, each turned by its own
matrix, add up to a predicted vector, whose product with the vector of a class is that class's score.
Vectors are trained by noise-contrastive estimation in numpy inside the tasks, and the tasks' vectors
are averaged.  As the classes are few, normalisers of all pairs of classes are computed once by
batched matrix products, so every token has an exact, normalised probability.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import fold, ship, small_batches
from tillwise.session import materialize

END = b"\n"  # no word holds a line break
CLASSES, TAIL = 384, 64
WIDTH, NOISE = 16, 16
BATCH, GROUP = 4096, 128
RATE, CALM = 0.1, 1e-6  # step size, and the squared gradients that each weight starts from
ROUNDS = 3
FREQUENT = 100_000
LONGEST_FREQUENT = 64  # bytes; with FREQUENT this bounds what is broadcast
COUNTER_WORDS = 200_000
CACHE_WORDS = 300_000


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words as bytes; ``bytes.lower`` and ``bytes.split`` know ASCII only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_class(word: bytes) -> int:
    """Class of a word that has none of its own, by its last three bytes."""
    return CLASSES - TAIL + zlib.crc32(word[-3:]) % TAIL


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task, given out whenever the counter is full."""

    def out() -> pa.RecordBatch:
        words = pa.array(list(counter), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [words, pa.array(list(counter.values()), pa.int64())], names=["word", "c"]
        )

    counter: Counter[bytes] = Counter()
    for b in small_batches(batches):
        for text in b.column("text").to_pylist():
            counter.update(tokens(text))
        counter[END] += b.num_rows
        if len(counter) > COUNTER_WORDS:
            yield out()
            counter.clear()
    if counter:
        yield out()


def is_training() -> F.Column:
    return F.coalesce(fold(F.col("doc_id")) != 1, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all given documents, the end token among the words; stored."""
    ship(docs.sparkSession)
    partial = docs.select("text").mapInArrow(_count, "word string, c bigint")
    return materialize(partial.groupBy("word").agg(F.sum("c").alias("c")))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, ``most`` at most and none over 64 bytes.

    A histogram of the counts in steps of an eighth of a power of two gives the least count that
    ``most`` words reach.  The list only says which words are looked up in place and which by a
    join; counts of either are exact.
    """
    step = F.floor(F.log2("c") * 8)
    histogram = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()
    total, least = 0, None
    for r in sorted(histogram, key=lambda r: -r["s"]):
        total += r["n"]
        if total > most:
            break
        least = r["s"]
    if least is None:
        return []
    rows = counts.filter((step >= least) & (F.octet_length("word") <= LONGEST_FREQUENT)).collect()
    return sorted(((r["word"].encode(), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _class_sums(own: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
            words = b.column("word").cast(pa.binary()).to_pylist()
            for word, c in zip(words, b.column("c").to_pylist(), strict=True):
                if word not in own:
                    k = tail_class(word)
                    n[k] += c
                    v[k] += 1
            used = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(n[used]), pa.array(v[used])], names=["k", "n", "v"]
            )

    return run


@dataclass
class Vocabulary:
    """Frequent words, their counts and classes; the totals of the corpus and of the tail classes."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    n: int  # training tokens
    v: int  # distinct training tokens
    class_n: np.ndarray  # training tokens by class
    class_v: np.ndarray  # distinct words by tail class

    @property
    def end(self) -> int:
        return 0

    def within(self) -> np.ndarray:
        """log10 of what a word's smoothed count is divided by within its class."""
        return np.log10(self.class_n + 0.5 * (self.class_v + 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    found = frequent_words(counts)
    ordered = [(w, c) for w, c in found if w == END] or [(END, 0)]
    ordered += [(w, c) for w, c in found if w != END]
    words = [w for w, _ in ordered]
    own = frozenset(words[: CLASSES - TAIL])
    rows = counts.mapInArrow(_class_sums(own), "k int, n bigint, v bigint")
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rows.groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        class_n[r["k"]], class_v[r["k"]] = r["n"], r["v"]
    number = np.array([c for _, c in ordered], float)
    classes = np.array([i if i < CLASSES - TAIL else tail_class(w) for i, w in enumerate(words)])
    alone = min(len(words), CLASSES - TAIL)
    class_n[:alone] = number[:alone]
    return Vocabulary(words, number, classes, int(n), int(v), class_n, class_v)


class _Lookup(dict):
    """Place of each word: frequent ones first, others as they are met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update(zip(self.vocab.words, range(len(self.vocab.words)), strict=True))
        self.more: list[int] = []
        self.classes = self.vocab.classes

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.more.append(tail_class(word))
        return place

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places and classes of words."""
        places = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.more:
            self.classes = np.concatenate([self.classes, self.more])
            self.more = []
        classes = self.classes[places]
        if len(self) > len(self.vocab.words) + CACHE_WORDS:
            self.reset()
        return places, classes


def _streams(classes: np.ndarray, sizes: np.ndarray, end: int):
    """Class of every token, ends too, the two classes before it, and where each text begins."""
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    y = np.full(begin[-1], end, np.int64)
    is_word = np.ones(len(y), bool)
    is_word[begin[1:] - 1] = False
    y[is_word] = classes
    before = np.concatenate([[end], y[:-1]])
    second = np.concatenate([[end], before[:-1]])
    second[begin[:-1]] = end
    return y, before, second, begin, is_word


@dataclass
class LogBilinear:
    inputs: np.ndarray  # classes x width
    turn1: np.ndarray  # for the class before
    turn2: np.ndarray  # for the one before that
    outputs: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(class_n: np.ndarray, seed: int = 5) -> LogBilinear:
        rng = np.random.default_rng(seed)
        share = (class_n + 0.5) / (class_n + 0.5).sum()
        draw = lambda *shape: (rng.normal(0, 0.1, shape)).astype(np.float32)
        eye = np.eye(WIDTH, dtype=np.float32)
        return LogBilinear(
            draw(CLASSES, WIDTH),
            eye + draw(WIDTH, WIDTH),
            0.5 * eye + draw(WIDTH, WIDTH),
            draw(CLASSES, WIDTH),
            np.log(share).astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.turn1, self.turn2, self.outputs, self.bias]

    def pack(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def unpack(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return LogBilinear(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of each class after each class, for both places, and log normalisers of all pairs."""
        one = self.inputs @ self.turn1 @ self.outputs.T + self.bias
        two = self.inputs @ self.turn2 @ self.outputs.T
        top1, top2 = one.max(axis=1), two.max(axis=1)
        # sum over y of exp(one[a, y]) * exp(two[b, y]): one matrix product for all pairs
        sums = np.exp(one - top1[:, None]).astype(float) @ np.exp(two - top2[:, None]).astype(float).T
        return one, two, np.log(sums) + top1[:, None] + top2[None, :]


def contrast(model: LogBilinear, noise: np.ndarray, y, before, second, rng, memory) -> None:
    """One step of noise-contrastive estimation on a batch, in place, with per-weight step sizes.

    Every ``GROUP`` tokens share ``NOISE`` draws, so a batch sees many different ones at the cost of
    one small matrix product per group.
    """
    n, groups = CLASSES, len(y) // GROUP
    drawn = np.searchsorted(noise.cumsum(), rng.random((groups, NOISE))).clip(0, n - 1)
    log_noise = np.log(noise * NOISE).astype(np.float32)
    a, b = model.inputs[before], model.inputs[second]
    guess = a @ model.turn1 + b @ model.turn2
    real = (guess * model.outputs[y]).sum(1) + model.bias[y] - log_noise[y]
    grouped = guess.reshape(groups, GROUP, WIDTH)
    against = model.outputs[drawn]
    fake = grouped @ against.transpose(0, 2, 1) + (model.bias - log_noise)[drawn][:, None, :]
    d_real = -1 / (1 + np.exp(np.clip(real, -30, 30)))  # of minus the log-likelihood
    d_fake = 1 / (1 + np.exp(-np.clip(fake, -30, 30)))
    d_guess = d_real[:, None] * model.outputs[y] + (d_fake @ against).reshape(-1, WIDTH)

    def gather(where: np.ndarray, what: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(where, what[:, j], minlength=n) for j in range(what.shape[1])], 1)

    flat = drawn.ravel()
    outputs = gather(y, d_real[:, None] * guess)
    outputs += gather(flat, (d_fake.transpose(0, 2, 1) @ grouped).reshape(-1, WIDTH))
    bias = np.bincount(y, d_real, minlength=n) + np.bincount(flat, d_fake.sum(1).ravel(), minlength=n)
    inputs = gather(before, d_guess @ model.turn1.T) + gather(second, d_guess @ model.turn2.T)
    grads = [inputs, a.T @ d_guess, b.T @ d_guess, outputs, bias]
    for p, g, m in zip(model.parts(), grads, memory, strict=True):
        g = g / len(y)
        m += g * g
        p -= (RATE * g / np.sqrt(m)).astype(np.float32)


def _train(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = broadcast.value
        model = LogBilinear.fresh(vocab.class_n).unpack(flat)
        noise = (vocab.class_n + 0.5) / (vocab.class_n + 0.5).sum()
        lookup, rng = _Lookup(vocab), np.random.default_rng(TaskContext.get().partitionId())
        memory = [np.full(p.shape, CALM) for p in model.parts()]
        seen = 0
        for b in small_batches(batches):
            words, sizes = [], []
            for text in b.column("text").to_pylist():
                own = tokens(text)
                words += own
                sizes.append(len(own))
            _, classes = lookup.find(words)
            y, before, second, _, _ = _streams(classes, np.array(sizes), vocab.end)
            order = rng.permutation(len(y))
            for lo in range(0, len(order), BATCH):
                k = order[lo : lo + BATCH]
                k = np.resize(k, -(-len(k) // GROUP) * GROUP)  # the last group is filled up
                contrast(model, noise, y[k], before[k], second[k], rng, memory)
            seen += len(y)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen], pa.int64()), pa.array([model.pack().astype(float)], pa.list_(pa.float64()))],
                names=["n", "weights"],
            )

    return run


def fit(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """Trains on every given document once, in ``rounds`` rounds over disjoint parts of them.

    In a round each task takes the common weights over its own documents; the results are averaged,
    weighted by tokens, by an aggregation per weight.  The driver sees one number per weight.
    """
    ship(docs.sparkSession)
    model = LogBilinear.fresh(vocab.class_n)
    part = F.pmod(F.xxhash64(F.lit("lm"), "doc_id"), F.lit(rounds))
    for r in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((vocab, model.pack()))
        trained = docs.filter(part == r).select("text").mapInArrow(
            _train(shared), "n bigint, weights array<double>"
        )
        each = trained.select("n", F.posexplode("weights").alias("i", "w"))
        mean = each.groupBy("i").agg((F.sum(F.col("n") * F.col("w")) / F.sum("n")).alias("w"))
        rows = mean.collect()
        if rows:
            flat = np.zeros(len(rows))
            for x in rows:
                flat[x["i"]] = x["w"]
            model = model.unpack(flat)
    return model


@dataclass
class Scorer:
    vocab: Vocabulary
    one: np.ndarray
    two: np.ndarray
    normaliser: np.ndarray

    @staticmethod
    def of(vocab: Vocabulary, model: LogBilinear) -> Scorer:
        one, two, z = model.tables()
        return Scorer(vocab, one.astype(np.float32), two.astype(np.float32), z.astype(np.float32))

    def class_scores(self, y: np.ndarray, before: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 p(class | two classes before) of every token."""
        nat = self.one[before, y] + self.two[second, y] - self.normaliser[before, second]
        return nat.astype(float) / math.log(10)


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Scorer = broadcast.value
        lookup, many = _Lookup(s.vocab), len(s.vocab.words)
        log_count = np.log10(s.vocab.counts + 0.5)
        known_count = s.vocab.counts > 0
        within = s.vocab.within()
        base_each = math.log10(s.vocab.n + 0.5 * (s.vocab.v + 1))
        row = TaskContext.get().partitionId() << 33
        for b in small_batches(batches):
            words, sizes = [], []
            for text in b.column("text").to_pylist():
                own = tokens(text)
                words += own
                sizes.append(len(own))
            sizes = np.array(sizes)
            places, classes = lookup.find(words)
            y, before, second, begin, is_word = _streams(classes, sizes, s.vocab.end)
            place = np.zeros(len(y), np.int64)  # the end token stands first
            place[is_word] = places
            rare = place >= many
            near = np.where(rare, 0, place)
            count = np.where(rare, 0.0, log_count[near])
            in_class = np.where(y >= CLASSES - TAIL, count - within[y], 0.0)
            lm = np.add.reduceat(s.class_scores(y, before, second) + in_class, begin[:-1])
            base = np.add.reduceat(count, begin[:-1]) - (sizes + 1) * base_each
            known = np.add.reduceat((~rare & known_count[near]).astype(np.int64), begin[:-1])
            where = np.flatnonzero(places >= many)
            at = np.searchsorted(where, np.concatenate([[0], np.cumsum(sizes)]))
            own = pa.array([words[i] for i in where], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + b.num_rows), pa.int64()),
                    b.column("doc_id"),
                    pa.array(sizes + 1, pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(lm, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), own),
                ],
                names=["row", "doc_id", "n_tokens", "known", "base", "lm", "rare"],
            )
            row += b.num_rows

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Counts and the network are learned from all documents whose fold is not 1.  A null text is empty
    and has the end token only.  Frequent words are looked up in a table of bounded size; each other
    word meets its exact count in a join, so no table of all words is ever in one place.  As frequent
    words never enter the join, no key of it is hot.  Repeated rows repeat.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    training = slim.filter(is_training())
    counts = word_counts(training)
    vocab = vocabulary(counts)
    scorer = Scorer.of(vocab, fit(training, vocab))
    schema = "row bigint, doc_id bigint, n_tokens bigint, known bigint, base double, lm double, rare array<string>"
    parts = materialize(slim.mapInArrow(_score(spark.sparkContext.broadcast(scorer)), schema))
    met = parts.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rest = met.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("s"), F.count("c").alias("k")
    )
    more = F.coalesce("s", F.lit(0.0))
    return parts.drop("rare").join(rest, "row", "left").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("lm") + more).alias("score"),
    )
