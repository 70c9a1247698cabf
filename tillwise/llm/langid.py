"""Language of every word by a linear-chain conditional random field, and of a text by its words.

A word is a run of letters.  Its features are character pairs and triples with marks at both ends of
the word, its affixes of three letters, and the word itself when the training texts hold it twice or
more.  Transitions between the languages of neighbouring words are learned together with the feature
weights, from texts that switch language as well as from texts that do not.  Labels come from
forward-backward over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import fold, mix, ship, small_batches
from tillwise.session import materialize

UNDETERMINED = "und"
DOCS_PER_LABEL = 500  # expected number of training documents of each label
SEGMENTS = 6  # training segments of a document, spread evenly over it
SEGMENT_WORDS = 40
BUCKETS = 1 << 16
EPOCHS = 6
BATCH = 256
RATE = 0.05
DECAY = 1e-5
CACHE_WORDS = 150_000
BATCH_BYTES = 1_500_000

_WORD = re.compile(r"[^\W\d_]+")
ORDERS = ("pair", "triple", "affix", "lexicon")


def letters(text: str | None) -> list[str]:
    """Words of a text in lower case; digits and marks separate words."""
    return _WORD.findall((text or "").lower())


@dataclass
class Features:
    """Hashed features of distinct words: for each order buckets and weights, cut at ``starts``."""

    buckets: dict[str, np.ndarray]
    values: dict[str, np.ndarray]
    starts: np.ndarray
    n: int

    def word_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(np.append(self.starts, len(self.values["pair"]))))


def featurize(words: list[str], lexicon: np.ndarray) -> Features:
    """Features of all words at once, from one array of their code points with end marks."""
    chars = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    c = chars.astype(np.uint64)
    left = np.repeat(starts + size, size) - np.arange(len(c))  # characters up to the end of the word
    scale = np.repeat(1 / np.sqrt(size), size).astype(np.float32)

    def run(k: int) -> np.ndarray:
        h = np.full(len(c), k, np.uint64)
        for j in range(k):
            h[: len(c) - j] = h[: len(c) - j] * np.uint64(0x100000001B3) + c[j:] + np.uint64(7)
        return mix(h)

    runs = {2: run(2), 3: run(3), 4: run(4)}
    at_start = np.zeros(len(c), bool)
    at_start[starts] = True
    edge = (left >= 4) & (at_start | (left == 4))
    # a hash of the whole word: the sum of its characters, each scrambled with its place
    place = np.arange(len(c)) - np.repeat(starts, size)
    own = np.add.reduceat(mix(c * np.uint64(0x9E3779B9) + place.astype(np.uint64) + np.uint64(1)), starts)
    known = np.isin(own, lexicon)
    word_bucket, word_value = np.zeros(len(c), np.int64), np.zeros(len(c), np.float32)
    word_bucket[starts] = (own % np.uint64(BUCKETS)).astype(np.int64)
    word_value[starts] = known
    cut = lambda h: (h % np.uint64(BUCKETS)).astype(np.int64)
    return Features(
        {"pair": cut(runs[2]), "triple": cut(runs[3]), "affix": cut(runs[4]), "lexicon": word_bucket},
        {
            "pair": np.where(left >= 2, scale, 0).astype(np.float32),
            "triple": np.where(left >= 3, scale, 0).astype(np.float32),
            "affix": edge.astype(np.float32),
            "lexicon": word_value,
        },
        starts,
        len(words),
    )


def word_keys(words: list[str]) -> np.ndarray:
    """The whole-word hashes that ``featurize`` looks up in the lexicon."""
    if not words:
        return np.zeros(0, np.uint64)
    chars = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(starts, size)
    c = chars.astype(np.uint64)
    return np.add.reduceat(mix(c * np.uint64(0x9E3779B9) + place.astype(np.uint64) + np.uint64(1)), starts)


@dataclass
class Crf:
    labels: list[str]
    weights: dict[str, np.ndarray]  # per order: BUCKETS x labels
    bias: np.ndarray
    step: np.ndarray  # transition scores, from row to column
    begin: np.ndarray
    lexicon: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of every word for every label."""
        return self._score(featurize(words, self.lexicon))

    def _score(self, f: Features) -> np.ndarray:
        total = np.tile(self.bias, (f.n, 1))
        for o in ORDERS:
            total += np.add.reduceat(self.weights[o][f.buckets[o]] * f.values[o][:, None], f.starts)
        return total


def forward_backward(crf: Crf, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probability of each label at each word; words of text i are ``at[i]:at[i + 1]``.

    All texts move forward one word at a time together, longest first, so a step is one small matrix
    product; each step is scaled to sum to 1.
    """
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    start, size = at[:-1][order], size[order]
    if not len(size):
        return np.zeros_like(scores)
    move = np.exp(crf.step - crf.step.max()).astype(np.float32)
    emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
    active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
    alpha = np.empty_like(emit)
    a = np.exp(crf.begin - crf.begin.max()).astype(np.float32) * emit[start]
    a /= a.sum(axis=1, keepdims=True)
    alpha[start] = a
    for t in range(1, size[0]):
        k = active[t]
        spot = start[:k] + t
        a = (a[:k] @ move) * emit[spot]
        a /= a.sum(axis=1, keepdims=True)
        alpha[spot] = a
    b = np.ones((len(size), len(move)), np.float32)
    back = move.T.copy()
    for t in range(size[0] - 2, -1, -1):
        k = active[t + 1]
        spot = start[:k] + t
        x = (emit[spot + 1] * b[:k]) @ back
        x /= x.sum(axis=1, keepdims=True)
        b[:k] = x
        alpha[spot] *= x
    return alpha / alpha.sum(axis=1, keepdims=True)


def _sequences(rows: list[tuple[str, list[str]]], labels: list[str], rng) -> list[tuple[list[str], list[int]]]:
    """Training sequences: every segment, and half of them cut short and continued in another language."""
    out = []
    number = {x: i for i, x in enumerate(labels)}
    for lang, words in rows:
        out.append((words, [number[lang]] * len(words)))
        if len(labels) > 1 and rng.random() < 0.5:
            lang2, other = rows[rng.integers(len(rows))]
            cut, cut2 = rng.integers(1, len(words) + 1), rng.integers(1, len(other) + 1)
            out.append((words[:cut] + other[:cut2], [number[lang]] * cut + [number[lang2]] * cut2))
    return out


def train(rows: list[tuple[str, list[str]]], epochs: int = EPOCHS, seed: int = 11) -> Crf:
    """Fits weights and transitions by Adam on the log-likelihood of the label sequences."""
    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in rows})
    counts = Counter(w for _, words in rows for w in set(words))
    lexicon = np.unique(word_keys([w for w, n in counts.items() if n > 1]))
    n = len(labels)
    crf = Crf(
        labels,
        {o: np.zeros((BUCKETS, n), np.float32) for o in ORDERS},
        np.zeros(n, np.float32),
        np.zeros((n, n), np.float32),
        np.zeros(n, np.float32),
        lexicon,
    )
    if n < 2:
        return crf
    params = {**crf.weights, "bias": crf.bias, "step": crf.step, "begin": crf.begin}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    sequences = _sequences(rows, labels, rng)
    moves = 0
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for lo in range(0, len(order), BATCH):
            grads = _gradient(crf, [sequences[i] for i in order[lo : lo + BATCH]])
            moves += 1
            for k, p in params.items():
                g = grads[k] + DECAY * p
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                fix = np.sqrt(1 - 0.99**moves) / (1 - 0.9**moves)
                p -= RATE * fix * first[k] / (np.sqrt(second[k]) + 1e-7)
    return crf


def _gradient(crf: Crf, batch: list[tuple[list[str], list[int]]]) -> dict[str, np.ndarray]:
    """Gradient of the mean negative log-likelihood of the label sequences."""
    words = [w for s, _ in batch for w in s]
    gold = np.array([y for _, ys in batch for y in ys])
    at = np.concatenate([[0], np.cumsum([len(s) for s, _ in batch])])
    types = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([types[w] for w in words])
    f = featurize(list(types), crf.lexicon)
    scores = crf._score(f)[ids]
    n = len(crf.labels)
    prob, pairs = _expectations(crf, scores, at)
    diff = prob.copy()
    diff[np.arange(len(gold)), gold] -= 1
    first = at[:-1]
    inner = np.ones(len(gold), bool)
    inner[at[1:] - 1] = False
    here = np.flatnonzero(inner)
    seen = np.bincount(gold[here] * n + gold[here + 1], minlength=n * n).reshape(n, n)
    scale = 1 / len(gold)
    by_type = np.stack([np.bincount(ids, diff[:, j], minlength=f.n) for j in range(n)], 1)
    owner = f.word_of()
    out = {
        "bias": (diff.sum(0) * scale).astype(np.float32),
        "step": ((pairs - seen) * scale).astype(np.float32),
        "begin": (diff[first].sum(0) * scale).astype(np.float32),
    }
    for o in ORDERS:
        used = np.flatnonzero(f.values[o])
        weight = f.values[o][used, None] * by_type[owner[used]]
        out[o] = np.stack(
            [np.bincount(f.buckets[o][used], weight[:, j], minlength=BUCKETS) for j in range(n)], 1
        ).astype(np.float32) * np.float32(scale)
    return out


def _expectations(crf: Crf, scores: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word and expected number of each transition."""
    size = np.diff(at)
    longest = size.max()
    n = scores.shape[1]
    emit = np.ones((len(size), longest, n))
    here = np.arange(longest)[None, :] < size[:, None]
    emit[here] = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    move = np.exp(crf.step - crf.step.max()).astype(float)
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    a = np.exp(crf.begin - crf.begin.max()) * emit[:, 0]
    for t in range(longest):
        if t:
            a = (alpha[:, t - 1] @ move) * emit[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((n, n))
    for t in range(longest - 2, -1, -1):
        live = here[:, t + 1]
        right = emit[:, t + 1] * beta[:, t + 1]
        b = right @ move.T
        beta[live, t] = (b / b.sum(axis=1, keepdims=True))[live]
        joint = alpha[live, t, :, None] * move * right[live, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
    prob = (alpha * beta)[here]
    return prob / prob.sum(axis=1, keepdims=True), pairs


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few runs of words of each training text, from its beginning to its end."""
    for b in small_batches(batches):
        langs, texts = [], []
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = letters(text)
            places = np.unique(np.linspace(0, max(len(words) - SEGMENT_WORDS, 0), SEGMENTS).astype(int))
            for p in places if words else []:
                langs.append(lang)
                texts.append(" ".join(w[:64] for w in words[p : p + SEGMENT_WORDS]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(texts, pa.string())], names=["lang", "words"]
        )


def fit(docs: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Crf | None:
    """A model from labelled documents outside of fold 0; None when there are none.

    About ``docs_per_label`` documents of each label, chosen by a hash of doc_id, give ``SEGMENTS``
    runs of ``SEGMENT_WORDS`` words each: the bound of what reaches the driver.
    """
    known = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    grain = 1 << 30
    share = F.create_map(
        *[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(grain * min(1.0, docs_per_label / n))))]
    )
    picked = known.filter(F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(grain)) < F.get(F.map_values(share), F.array_position(F.map_keys(share), F.col("lang")).cast("int") - 1))
    ship(docs.sparkSession)
    found = picked.select("doc_id", "lang", "text").mapInArrow(_segments, "lang string, words string")
    rows = sorted((r["lang"], r["words"]) for r in found.collect())
    return train([(lang, words.split(" ")) for lang, words in rows]) if rows else None


class _Cache(dict):
    """Place of each word met by a worker in its table of scores."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place


class _Labeller:
    def __init__(self, crf: Crf):
        self.crf = crf
        self.reset()

    def reset(self) -> None:
        self.cache = _Cache()
        self.scores = np.zeros((1024, len(self.crf.labels)), np.float32)
        self.real = np.zeros(1024, bool)

    def _places(self, words: list[str]) -> np.ndarray:
        done = len(self.cache)
        places = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        new, self.cache.new = self.cache.new, []
        if new:
            need = done + len(new)
            if need > len(self.real):
                self.scores = np.concatenate([self.scores, np.zeros((need, self.scores.shape[1]), np.float32)])
                self.real = np.concatenate([self.real, np.zeros(need, bool)])
            for lo in range(0, len(new), 20_000):
                self.scores[done + lo : done + min(lo + 20_000, len(new))] = self.crf.emissions(new[lo : lo + 20_000])
            self.real[done:need] = [w.isalpha() or any(map(str.isalpha, w)) for w in new]
        return places

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of every word and the offsets of the texts."""
        if len(self.cache) > CACHE_WORDS:
            self.reset()
        words, sizes = [], []
        for text in texts:
            own = letters(text)
            words += own
            sizes.append(len(own))
        at = np.concatenate([[0], np.cumsum(sizes)])
        places = self._places(words)
        del words
        real = self.real[places]
        if not real.all():  # signs such as fractions count as words for the pattern but are no letters
            kept = np.concatenate([[0], np.cumsum(real)])
            places, at = places[real], kept[at]
        return forward_backward(self.crf, self.scores[places], at), at


def _texts_label(labeller: _Labeller | None, texts: list[str | None]):
    """(label, score, number of words, run labels, run sizes, run offsets) of the texts."""
    n = len(texts)
    if labeller is None:
        return [UNDETERMINED] * n, np.zeros(n), np.zeros(n, int), [], [], np.zeros(n + 1, np.int32)
    prob, at = labeller.label(texts)
    labels = labeller.crf.labels
    size = np.diff(at)
    some = size > 0
    total = np.zeros((n, len(labels)))
    if some.any():
        total[some] = np.add.reduceat(prob, at[:-1][some]) if len(prob) else 0
    best = total.argmax(axis=1)
    score = np.where(some, total[np.arange(n), best] / np.maximum(size, 1), 0.0)
    names = [labels[i] if s else UNDETERMINED for i, s in zip(best, some, strict=True)]
    word = prob.argmax(axis=1)
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    new[at[:-1][some]] = True
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(word)))
    return names, np.clip(score, 0, 1), size, [labels[i] for i in word[first]], runs, np.searchsorted(first, at)


def _explained(labeller: _Labeller | None, texts: list[str | None], least: float) -> np.ndarray:
    """Whether the most likely labels of a text's words, one or many, have a mean probability of ``least``."""
    if labeller is None:
        return np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
    prob, at = labeller.label(texts)
    size = np.diff(at)
    total = np.zeros(len(texts))
    if len(prob):
        total[size > 0] = np.add.reduceat(prob.max(axis=1), at[:-1][size > 0])
    return (size > 0) & (total >= least * size)


def _labelled(model, keep: list[str] | None, least: float):
    """Adds labels to batches, or with ``keep`` passes on the rows whose words have sure enough labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _Labeller(model.value) if model.value is not None else None
        for b in small_batches(batches, BATCH_BYTES):
            texts = b.column("text").to_pylist()
            if keep:
                yield b.filter(pa.array(_explained(labeller, texts, least), pa.bool_())).select(keep)
                continue
            names, score, size, run_labels, runs, offsets = _texts_label(labeller, texts)
            pieces = pa.StructArray.from_arrays(
                [pa.array(run_labels, pa.string()), pa.array(runs, pa.int32())], names=["lang", "words"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(names, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(size, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces),
                ],
                names=["doc_id", "lang_pred", "score", "n_words", "runs"],
            )

    return run


def label_documents(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words and runs (language and number of words) of every document.

    ``score`` is the mean probability of the label over the words.  A null text and one without
    letters get ``und`` and 0, as does every text when there is no model.  Repeated rows repeat.
    The whole text is labelled, however long; a batch holds a few megabytes of text or one row.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(crf)
    schema = "doc_id bigint, lang_pred string, score double, n_words bigint, runs array<struct<lang:string,words:int>>"
    return docs.select("doc_id", "text").mapInArrow(_labelled(model, None, 0.0), schema)


def predict_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words of every document, learned from the other folds."""
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return label_documents(docs, fit(docs)).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "n_words"
    )


def keep_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without texts that no known language explains; all their columns.

    Each word counts with its own most likely language, so texts in several languages stay; their words'
    mean probability must be ``least``.  Without a model all texts with letters stay.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    return docs.mapInArrow(_labelled(model, docs.columns, least), docs.schema)
