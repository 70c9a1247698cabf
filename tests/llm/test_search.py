"""Lexical search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tillwise.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, top=10):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, w, Counter(w)) for d, w in bags if w]
    n_docs, length = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for *_, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, w, c in bags:
            m = 10 + (90 * len(w) * n_docs) // length
            s = 0
            for t in set(terms(text)) & set(c):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += weight * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, d))
        scored.sort(key=lambda r: (r[0], r[1] is None, r[1]))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(scored[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["É", "straße", "x-y", "A.b", "東京", "don't"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 120)))) for i in range(500)]
    docs += [(500 + i, docs[3][1]) for i in range(30)]  # a group of copies: ties by doc_id
    docs += [(900, None), (901, ""), (902, "... !"), (903, "w1 " * 20_000), (None, docs[5][1]), (904, docs[4][1].upper())]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 40)))) for i in range(25)]
    items += [(50, docs[3][1]), (51, None), (52, "nothing here"), (53, "w1")]
    return docs, items


def frames(spark, docs, items):
    left = spark.createDataFrame([(d, t, 1, "r") for d, t in docs], "doc_id bigint, text string, rank int, cells string")
    right = spark.createDataFrame([(i, t, 2.0) for i, t in items], "item_id bigint, text string, score double")
    return left.repartition(5), right


def test_ranking_equals_scoring_everything(spark, corpus):
    got = search.lexical_search(*frames(spark, *corpus)).collect()
    assert sorted(map(tuple, got), key=str) == plain(*corpus)


@pytest.mark.parametrize("cells, block", [(4_000, 4), (60_000, 16)])
def test_segments_and_blocks_of_any_size(corpus, cells, block, monkeypatch):
    """Skipped blocks change nothing, whatever their size; with larger segments much is skipped."""
    monkeypatch.setattr(search, "CELLS", cells)
    docs, items = corpus
    vocabulary = sorted({t for _, text in items for t in terms(text)})
    place = {t: i for i, t in enumerate(vocabulary)}
    bags = [(d, terms(t)) for d, t in docs if terms(t) and d is not None]
    df = Counter(t for _, w in bags for t in set(w))
    weights = np.array([search.term_weight(len(bags), df[t]) for t in vocabulary], np.int64)
    asked = [(k, t) for k, t in items if terms(t)]
    queries = [search.Query(k, np.unique([place[t] for t in terms(text)])) for k, text in asked]
    rank = search.Ranking(queries, weights, len(bags), sum(len(w) for _, w in bags), 10)
    scores = np.zeros((len(bags), len(vocabulary)), np.int64)
    for i, (_, w) in enumerate(bags):
        c = Counter(t for t in w if t in place)
        at = np.array([place[t] for t in c], int)
        scores[i, at] = search.term_scores(rank, at, np.array(list(c.values()), np.int64), np.full(len(c), len(w)))
    order = np.argsort(-weights, kind="stable")
    holders = [[q for q, query in enumerate(queries) if t in query.terms] for t in range(len(vocabulary))]
    best = [search.Best(10) for _ in queries]
    ids, size = np.array([d for d, _ in bags]), max(cells // len(vocabulary), 1)
    monkeypatch.setattr(search.cluster, "__defaults__", (block,))
    looked = 0
    for first in range(0, len(bags), size):
        part = slice(first, first + size)
        looked += search.search_segment(rank, search.Segment(rank, ids[part], scores[part]), best, order, holders)
    got = sorted(
        ((q.key, i + 1, int(d), int(s)) for q, b in zip(queries, best, strict=True) for i, (s, d) in enumerate(zip(b.score, b.doc))),
        key=str,
    )
    assert got == plain([(d, t) for d, t in docs if d is not None], asked)
    assert looked < 0.9 * len(bags) * len(queries)


def test_summaries_bound_every_document():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 10**9, (200, 12)) * (rng.random((200, 12)) < 0.4)
    seg = search.Segment(search.Ranking([], np.ones(12, np.int64), 1, 1, 10), np.arange(200), scores)
    for term in range(12):
        rows, start = seg.blocks(term)
        assert sorted(rows) == np.flatnonzero(scores[:, term]).tolist()
        top = seg.summaries(rows, start, np.arange(12)).astype(np.int64) * seg.unit
        of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(rows))))
        assert (top[of] >= scores[rows]).all()
        assert (np.diff(np.append(start, len(rows))) > 0).all() and len(start) > 1


def test_empty_tables_and_repeated_items(spark):
    docs, items = frames(spark, [(1, "a b"), (1, "a b"), (2, "a")], [(7, "b a"), (7, "b a"), (None, "a")])
    got = [tuple(r) for r in search.lexical_search(docs, items).orderBy("rank").collect()]
    assert [r[:3] for r in got] == [(7, 1, 1), (7, 2, 1), (7, 3, 2)] and got[0][3] == got[1][3]
    assert search.lexical_search(docs.limit(0), items).count() == 0
    assert search.lexical_search(docs, items.limit(0)).count() == 0
    assert search.lexical_search(docs.filter("doc_id < 0"), items).count() == 0


def test_items_go_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(search, "ITEMS_PER_PASS", 12)
    got = search.lexical_search(*frames(spark, *corpus)).collect()
    assert sorted(map(tuple, got), key=str) == plain(*corpus)
