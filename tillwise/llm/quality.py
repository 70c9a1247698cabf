"""Text quality by a sparse rule ensemble.

Statistics of a text are cut from its bytes.  Shallow trees over them are grown on labelled rows, every
path from a root becomes a conjunctive rule, a logistic regression with an L1 penalty weighs the rules
and leaves most of them out, and what is left is compiled into one Spark column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import cut_words, fold, ship, small_batches, text_bytes
from tillwise.session import materialize, scratch_path

TREES, DEPTH = 24, 3
PENALTY = 0.001
THRESHOLD = 0.3

STATS = [
    "n_words",
    "word_bytes",
    "distinct_words",
    "distinct_pairs",
    "top_word",
    "same_as_before",
    "upper",
    "digits",
    "symbols",
    "symbol_ends",
    "pipes",
    "full_stops",
    "commas",
    "short_words",
    "high_bytes",
    "lines_per_word",
    "line_repeats",
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _distinct(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each text and the largest number of times one occurs."""
    if not len(value):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    new = np.ones(len(v), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(v)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[first], times)
    return np.bincount(o[first], minlength=n).astype(float), most.astype(float)


def text_statistics(column: pa.Array) -> np.ndarray:
    """Statistics (texts x STATS) from whole texts; an empty text has zeros."""
    low, cuts = text_bytes(column)
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    n = len(cuts) - 1
    w = cut_words(low, cuts)
    owner = np.repeat(np.arange(n), np.diff(w.at))
    words = np.diff(w.at).astype(float)
    h = w.hashes()
    size = w.end - w.start

    def share(mask: np.ndarray) -> np.ndarray:
        """Of the bytes of each text."""
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[cuts[1:]] - total[cuts[:-1]]) / np.maximum(np.diff(cuts), 1)

    def of_words(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner, flags, minlength=n) / np.maximum(words, 1)

    distinct, most = _distinct(owner, h, n)
    follows = owner[1:] == owner[:-1]
    pairs = (h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])[follows]
    distinct_pairs, _ = _distinct(owner[1:][follows], pairs, n)
    same = np.zeros(len(h), bool)
    same[1:] = follows & (h[1:] == h[:-1])
    upper = (raw >= 65) & (raw <= 90)
    last = low[np.maximum(w.end - 1, 0)] if len(low) else low
    edges = np.unique(np.concatenate([cuts, np.flatnonzero(low == 10) + 1]))
    lines = cut_words(low, edges)
    filled = np.flatnonzero(np.diff(lines.at))
    line_owner = np.searchsorted(cuts, edges[:-1], "right") - 1
    line_hash = (
        np.add.reduceat(h * (np.arange(len(h), dtype=np.uint64) - np.repeat(lines.at[:-1], np.diff(lines.at)).astype(np.uint64) + np.uint64(1)), lines.at[:-1][filled])
        if len(filled)
        else h
    )
    distinct_lines, _ = _distinct(line_owner[filled], line_hash, n)
    n_lines = np.bincount(line_owner[filled], minlength=n).astype(float)
    stats = {
        "n_words": words,
        "word_bytes": of_words(size),
        "distinct_words": distinct / np.maximum(words, 1),
        "distinct_pairs": distinct_pairs / np.maximum(words - 1, 1),
        "top_word": most / np.maximum(words, 1),
        "same_as_before": of_words(same),
        "upper": share(upper),
        "digits": share(_DIGIT[low]),
        "symbols": share(_SYMBOL[low]),
        "symbol_ends": of_words(_SYMBOL[last]),
        "pipes": of_words((size == 1) & (last == ord("|"))),
        "full_stops": share(low == ord(".")),
        "commas": share(low == ord(",")),
        "short_words": of_words(size <= 3),
        "high_bytes": share(low >= 128),
        "lines_per_word": n_lines / np.maximum(words, 1),
        "line_repeats": 1 - distinct_lines / np.maximum(n_lines, 1),
    }
    stats["line_repeats"][n_lines == 0] = 0
    return np.stack([stats[s] for s in STATS], 1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches):
        stats = text_statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array(stats[:, i]) for i in range(len(STATS))]],
            names=["doc_id", *STATS],
        )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text; a null text is empty."""
    ship(docs.sparkSession)
    schema = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATS)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_measured, schema)


@dataclass(frozen=True)
class Rule:
    """Holds when every statistic lies on its side of its threshold: (name, above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        each = [(F.col(s) > t) if above else (F.col(s) <= t) for s, above, t in self.terms]
        return reduce(Column.__and__, each)

    def __str__(self) -> str:
        return " and ".join(f"{s} {'>' if above else '<='} {t:.6g}" for s, above, t in self.terms)


@dataclass
class RuleEnsemble:
    """Weighted rules; ``score`` is the column of the probability of label 1."""

    intercept: float
    weights: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_rules(model, spark) -> list[Rule]:
    """Every path from a root of a fitted forest as a rule, each once.

    The forest is stored and its table of nodes read: at most TREES * 2 ** (DEPTH + 1) rows.
    """
    path = scratch_path(spark)
    model.write().save(path)
    trees: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        node = r["nodeData"] if "nodeData" in r else r
        trees.setdefault(r["treeID"], {})[node["id"]] = node
    rules: dict[Rule, None] = {}

    def walk(nodes, at: int, terms: dict) -> None:
        node = nodes[at]
        if node["leftChild"] < 0:
            return
        name = STATS[node["split"]["featureIndex"]]
        threshold = node["split"]["leftCategoriesOrThreshold"][0]
        for above, child in ((False, node["leftChild"]), (True, node["rightChild"])):
            old = terms.get((name, above))
            best = threshold if old is None else (max if above else min)(old, threshold)
            mine = terms | {(name, above): best}
            rules[Rule(tuple(sorted((s, a, t) for (s, a), t in mine.items())))] = None
            walk(nodes, child, mine)

    for nodes in trees.values():
        walk(nodes, 0, {})
    return list(rules)


def fit(training: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleEnsemble:
    """Fits rules and weights on rows of statistics with a label column of 0 and 1.

    Without rows the score is 0.5 everywhere, with one class its smoothed share.
    """
    spark = training.sparkSession
    n, ones = training.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = (ones + 0.5) / (n + 1)
    flat = RuleEnsemble(float(np.log(share / (1 - share))), [])
    if not 0 < ones < n:
        return flat
    rows = VectorAssembler(inputCols=STATS, outputCol="features").transform(training).select("features", "label", *STATS)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=7, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird"
    ).fit(rows)
    rules = tree_rules(forest, spark)
    if not rules:
        return flat
    held = [r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(
        rows.select("label", *held)
    )
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False
    ).fit(fired.select("features", "label"))
    weights = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w]
    return RuleEnsemble(float(lasso.intercept), weights)


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with the quality label of documents outside of fold 0."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("label"))
    known = known.filter(F.col("label").isin(0.0, 1.0) & (fold(F.col("doc_id")) != 0))
    return stats.join(known, "doc_id")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels other than 0 and 1 and labels without a document teach nothing; an empty text is scored by
    its zero statistics; repeated rows repeat.  All labelled rows of the training folds are used, where
    they lie: trees and weights are fitted by distributed passes over their statistics.
    """
    stats = materialize(measure(docs))
    model = fit(materialize(training_rows(stats, labels)))
    score = model.score()
    return stats.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
        F.when(score >= threshold, 1).otherwise(0).alias("predicted"),
    )
