"""Operators against plain versions on small tables, and their edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from math import ceil, floor, log10

import numpy as np
import pyarrow as pa
import pytest

from brute import shingles, words
from pyspark.sql import functions as F
from tillwise.llm import common, decontam, exact, jaccard, langid, lines, links, lm, mixing, pagetext, quality
from tillwise.session import materialize

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, sim bigint, node string"
VOCAB = ["the", "of", "and", "to", "in", "Red", "blue,", "fox", "a.b", "é", "ß", "x|y", "|", "zz", "q1"]


def table(spark, texts, langs=None, sources=None, ids=None):
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    rows = [
        (ids[i], texts[i], (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], 0, 7, "node") for i in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def mutate(rng, text, share):
    w = text.split(" ")
    for _ in range(max(1, int(len(w) * share))):
        w[rng.randrange(len(w))] = rng.choice(VOCAB) + str(rng.randrange(100))
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    """Near copies, copies, empty, null, blank, short and long texts, in no order."""
    rng = random.Random(3)
    out = [None, "", " \n\t", "the", "The", "one two three four", "one two three four five", "x" * 5000]
    for _ in range(12):
        base = sentence(rng, rng.randrange(20, 120))
        out += [base, base.upper() if rng.random() < 0.5 else base]
        out += [mutate(rng, base, rng.choice([0.005, 0.02, 0.05, 0.2])) for _ in range(5)]
    out.append(sentence(rng, 20_000))
    hot = sentence(rng, 150)
    out += [mutate(rng, hot, 0.01) for _ in range(60)] + [hot] * 30
    rng.shuffle(out)
    return out


def test_words_of_batches():
    rng = random.Random(5)
    texts = [None, "", "A b\tC\x0bd\xa0e", "é ß", " x ", "no"] + [sentence(rng, 30) for _ in range(20)]
    array = pa.array(["skip", *texts]).slice(1)
    w = common.batch_words(array)
    data = w.data.tobytes()
    got = [
        [data[w.start[k] : w.end[k]].decode() for k in range(w.at[i], w.at[i + 1])] for i in range(len(texts))
    ]
    assert got == [words(t) for t in texts]
    hashes, at = common.shingle_hashes(w)
    for i, t in enumerate(texts):
        assert len(set(hashes[at[i] : at[i + 1]])) == len(shingles(t))


def test_exact(spark, texts):
    got = {r["doc_id"]: r for r in exact.exact_dedup(table(spark, texts)).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for same in groups.values():
        for i in same:
            assert (got[i]["keep_id"], got[i]["group_size"]) == (max(same), len(same))
            assert got[i]["kept"] == (i == max(same))
    assert exact.exact_dedup(table(spark, [])).count() == 0


def test_exact_without_ids(spark):
    """Equal texts meet whether or not they have an id; a row without one yields to one that has."""
    docs = table(spark, ["a", "a", "b", "b", "c", None, ""], ids=[None, 4, None, None, None, None, 5])
    got = sorted(map(tuple, exact.exact_dedup(docs).drop("text_sha256").collect()), key=str)
    want = [(None, 4, 2, False), (4, 4, 2, True), (None, None, 2, True), (None, None, 2, True)]
    want += [(None, None, 1, True), (None, 5, 2, False), (5, 5, 2, True)]
    assert got == sorted(want, key=str)


def test_exact_refines(spark):
    """Equal lengths and prefixes are not enough."""
    long = "p" * 400
    got = exact.exact_dedup(table(spark, [long + "a", long + "b", long + "a", "ab", "ba"])).collect()
    assert sorted((r["doc_id"], r["keep_id"]) for r in got) == [(0, 2), (1, 1), (2, 2), (3, 3), (4, 4)]


def test_connected_groups(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in common.connected_groups(df).collect()}
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: find(x) for x in root if x not in alone}


def test_jaccard(spark, texts):
    copies = defaultdict(list)
    for i, t in enumerate(texts):
        copies[tuple(words(t))].append(i)
    sets = {same[0]: shingles(texts[same[0]]) for w, same in copies.items() if len(w) >= 5}
    near, root = defaultdict(set), {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                near[a].add(b)
                near[b].add(a)
    changed = True
    while changed:
        changed = False
        for a in sets:
            low = min([root[a], *(root[b] for b in near[a])])
            changed |= low != root[a]
            root[a] = low
    docs = table(spark, texts)
    got = {r["doc_id"]: r for r in jaccard.jaccard_classes(docs).collect()}
    assert len(got) == len(texts)
    for w, same in copies.items():
        for i in same:
            head = same[0] if w else i
            assert got[i]["class_id"] == root.get(head, head), i
            assert got[i]["n_links"] == len(near[head])
            assert got[i]["n_linked_docs"] == sum(len(copies[tuple(words(texts[b]))]) for b in near[head])
            assert (got[i]["head_id"], got[i]["n_copies"]) == (head, len(same) if w else 1)
    kept = {r["doc_id"] for r in jaccard.keep_one_of_each(docs).collect()}
    assert kept == {i for i in got if got[i]["class_id"] == i}


def test_jaccard_of_a_large_family_stores_no_pairs(spark, monkeypatch):
    """Texts of one origin, most of them under the threshold: no stored table grows with their pairs."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(260):
        w = list(base)
        for at in rng.sample(range(400), 8):
            w[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [shingles(t) for t in texts]
    alike = [[len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets] for a in sets]
    rows = []

    def stored(df):
        out = materialize(df)
        rows.append(out.count())
        return out

    for module in (common, jaccard, links):
        monkeypatch.setattr(module, "materialize", stored)
    got = jaccard.jaccard_classes(table(spark, texts)).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: sum(a) - 1 for i, a in enumerate(alike)}
    assert sum(map(sum, alike)) < 0.8 * len(texts) ** 2
    assert max(rows) <= jaccard.BANDS * len(texts)


def test_ties_of_a_bucket():
    """Ties join what paths of close mates join, in small and large buckets, and are fewer than the rows."""

    def close(tag, n, other_tag, other_n):
        return np.abs(tag - other_tag) <= 1

    rng = np.random.default_rng(1)
    for rows in (2, 40, 300):
        tag = rng.integers(0, 2 * rows, rows)
        cols = [np.zeros(rows, np.int64), np.arange(rows), tag, np.zeros(rows, np.int64)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=links.NAMES)
        found = list(links._ties(close)(iter([batch])))
        a, b = (np.concatenate([[], *[x.column(c) for x in found]]).astype(int) for c in "ab")
        assert len(a) < rows
        order = np.argsort(tag)
        group = np.cumsum(np.diff(tag[order], prepend=tag[order][0]) > 1)
        want = {}
        for g, node in zip(group.tolist(), order.tolist(), strict=True):
            want.setdefault(g, []).append(node)
        tied = dict(zip(b.tolist(), a.tolist(), strict=True))
        assert tied == {n: min(nodes) for nodes in want.values() for n in nodes if n != min(nodes)}


def test_jaccard_edges(spark):
    assert jaccard.jaccard_classes(table(spark, [])).count() == 0
    docs = table(spark, ["a b c d e f", "a b c d e f", None, ""], ids=[None, 1, 2, None])
    rows = jaccard.jaccard_classes(docs).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["n_links"]) for r in rows) == [
        (-1, -1, 0), (-1, -1, 0), (1, 1, 0), (2, 2, 0)
    ]
    assert jaccard.keep_one_of_each(docs).count() == 4


def test_pruning_keeps_true_pairs():
    """At the threshold itself a pair survives all steps but for the tolerance."""
    rng = np.random.default_rng(0)
    hits = rng.random((20_000, jaccard.HASHES)) < 0.8
    alive = np.ones(len(hits), bool)
    for step, m in enumerate(jaccard.least_matches(0.8), 1):
        alive &= hits[:, : step * jaccard.STEP].sum(1) >= m
    assert alive.mean() > 0.999
    low = rng.random((20_000, jaccard.HASHES)) < 0.4
    assert (low[:, :60].sum(1) >= jaccard.least_matches(0.8)[2]).mean() < 0.05


def line_sets(texts):
    """Kept (doc, line) by comparing all pairs of lines."""
    long = {}
    for i, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            w = tuple(words(line))
            if len(w) >= lines.LEAST_WORDS:
                long.setdefault(w, []).append((i, k))
    keys = list(long)
    column = common.batch_words(pa.array([" ".join(w) for w in keys], pa.string()))
    h = column.hashes()
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if min(len(keys[a]), len(keys[b])) < lines.LEAST_FUZZY_WORDS:
                continue
            alike = lines.edit_similarity(h[column.at[a] : column.at[a + 1]], h[column.at[b] : column.at[b + 1]])
            if alike >= 0.8 - 1e-9:
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for a, w in enumerate(keys):
        groups[find(a)] += long[w]
    return {p for g in groups.values() for p in g if p != min(g)}, sum(len(g) > 1 for g in groups.values())


def test_lines(spark):
    rng = random.Random(9)
    pool = [sentence(rng, rng.randrange(1, 60)) for _ in range(40)]
    pool += [mutate(rng, p, 0.01) for p in pool if len(p.split(" ")) > 25] * 2
    pool += ["| a | b | c | d |", "| e | f | g | h |", "", "the", "so it is", "So  it\tis"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts += [None, "", "\n\n", pool[0], pool[0]]
    got = {r["doc_id"]: r for r in lines.dedup_lines(table(spark, texts)).collect()}
    surplus, groups = line_sets(texts)
    assert groups > 20 and len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["text"] is None and got[i]["n_lines"] == 0
            continue
        parts = t.split("\n")
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(parts) if (i, k) not in surplus)
        assert got[i]["n_removed"] == sum((i, k) in surplus for k in range(len(parts)))
    assert lines.dedup_lines(table(spark, [])).count() == 0
    again = lines.drop_emptied(lines.dedup_lines(table(spark, ["one two three four", "one two three four"])))
    assert [r["doc_id"] for r in again.collect()] == [0] and set(again.columns) == set(table(spark, []).columns)


def test_all_near_lines_are_found(spark):
    """Groups by edit similarity alone, over lines of 4 to 120 words with up to a fifth of them edited."""
    rng = random.Random(17)
    pool = []
    for _ in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 5, 6, 9, 10, 14, 15, 30, 50, 120]))]
        pool.append(base)
        for _ in range(2):
            w = list(base)
            for _ in range(rng.randrange(1, max(len(w) // 5, 1) + 1)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
            pool.append(w)
    pool = [list(w) for w in dict.fromkeys(map(tuple, pool)) if w]
    column = common.batch_words(pa.array([" ".join(w) for w in pool]))
    h = [column.hashes()[column.at[i] : column.at[i + 1]] for i in range(len(pool))]
    near = [(a, b) for b in range(len(pool)) for a in range(b) if lines.edit_similarity(h[a], h[b]) >= 0.8 - 1e-9]
    root = list(range(len(pool)))
    for _ in pool:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    got = lines.dedup_lines(table(spark, [" ".join(w) for w in pool])).collect()
    assert {r["doc_id"] for r in got if not r["n_removed"]} == {i for i in range(len(pool)) if root[i] == i}
    assert len(near) > 60


def test_word_counts_are_those_of_all_documents(spark):
    rng = random.Random(31)
    texts = [f"only{i} " + sentence(rng, rng.randrange(1, 30)) for i in range(60)] + ["", None]
    expected = np.zeros(lines.SLOTS, np.int64)
    h = common.batch_words(pa.array(texts)).hashes()
    np.add.at(expected, (h & np.uint64(lines.SLOTS - 1)).astype(np.int64), 1)
    assert (lines.word_counts(table(spark, texts)) == expected).all()


def test_lines_with_clashing_columns(spark):
    rows = [(1, "x y\nz", "a", "b", "c", 7), (2, "x y", "a", "b", "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _drop string, _id string, drop string, n_lines int")
    got = sorted(map(tuple, lines.dedup_lines(docs).collect()))
    assert got == [(1, "x y\nz", "a", "b", "c", 2, 0), (2, "", "a", "b", "c", 1, 1)]
    left = lines.drop_emptied(lines.dedup_lines(docs)).collect()
    assert [(r["doc_id"], r["drop"]) for r in left] == [(1, "c")]


def test_short_lines_lose_their_copies(spark):
    """Lines of one or two words, and paragraphs without spaces, are lines like others."""
    texts = ["Read more\n\nhttps://a.b\n今天天气很好我们去公园", "read  More\n \nhttps://a.b", "今天天气很好我们去公园\n\nx"]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table(spark, texts)).collect()}
    assert got == {0: texts[0], 1: " ", 2: "\nx"}


def test_edit_similarity():
    rng = np.random.default_rng(2)

    def plain(a, b):
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
            d = e
        return 1 - d[-1] / max(len(a), len(b), 1)

    for _ in range(200):
        a = rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64)
        b = rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64)
        assert lines.edit_similarity(a, b) == pytest.approx(plain(a, b))


def test_alike_is_edit_similarity():
    """Lines put in and taken out, changed in place and shuffled, some empty and some long."""
    rng = np.random.default_rng(6)
    a, b = [], []
    for n in [0, 0, 1, 4, 5, 10, 30, 80, 300] * 20:
        x = rng.integers(0, 40, n).astype(np.uint64)
        y = x.copy()
        for _ in range(rng.integers(0, n // 4 + 2)):
            at, kind = rng.integers(0, len(y) + 1), rng.integers(0, 3)
            if kind == 0:
                y = np.insert(y, at, rng.integers(0, 40))
            elif at < len(y):
                y = np.delete(y, at) if kind == 1 else np.concatenate([y[:at], [rng.integers(0, 40)], y[at + 1 :]])
        a.append(x)
        b.append((rng.permutation(x) if rng.random() < 0.1 else y).astype(np.uint64))
    at, bt = (np.concatenate([[0], np.cumsum([len(x) for x in rows])]) for rows in (a, b))

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row = row, [i]
            for j, q in enumerate(y):
                row.append(min(last[j] + (p != q), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    got = lines.alike(np.concatenate(a), at, np.concatenate(b), bt, 0.8)
    far = [distance(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]
    longest = [max(len(x), len(y)) for x, y in zip(a, b, strict=True)]
    assert got.tolist() == [5 * d <= n for d, n in zip(far, longest, strict=True)]
    assert 20 < got.sum() < len(got) - 20
    for x, y, d, n in zip(a, b, far, longest, strict=True):
        assert lines.edit_similarity(x, y) == pytest.approx(1 - d / n if n else 1)


def test_entries_of_lines_travel_packed(spark, monkeypatch):
    """No row for an entry: a few rows a batch and cell, and equal lines of a batch are entered once."""
    rng = random.Random(4)
    text = "\n".join(sentence(rng, 40) for _ in range(50))
    docs = table(spark, [text] * 40)
    rows = []

    def stored(df):
        out = materialize(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lines, "CELL_ENTRIES", 1_000)
    monkeypatch.setattr(lines, "materialize", stored)
    assert lines.surplus_lines(docs).count() == 39
    assert max(rows) <= 40 * 50
    counts = type("Sent", (), {"value": lines.word_counts(docs)})
    batch = pa.RecordBatch.from_pydict({"text": [text] * 40})
    packed = pa.Table.from_batches(lines._entries(counts, 0.8, 8)(iter([batch])))
    assert packed.num_rows <= 8
    found = np.frombuffer(b"".join(packed.column("entries").to_pylist()), lines.ENTRY)
    assert len(np.unique(found["key"])) == 50 and len(found) <= 50 * 17


def test_pairs_of_lines_that_are_not_alike_are_no_rows(spark, monkeypatch):
    """Lines that share three words of five, and many rare pairs: once there was a row for each two of them."""
    rng = random.Random(5)
    often = [f"v{i}" for i in range(300)]
    texts = [
        " ".join(f"s{3 * k} s{3 * k + 1} s{3 * k + 2} {rng.choice(often)} {rng.choice(often)}" for k in range(20))
        for _ in range(300)
    ]
    texts.append(" ".join(often * 400))
    rows = []

    def stored(df):
        out = materialize(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lines, "materialize", stored)
    monkeypatch.setattr(links, "materialize", stored)
    assert lines.surplus_lines(table(spark, texts)).count() == 0
    assert 300 < max(rows) < 300 * 299 // 4


def test_fewer_entries_still_meet():
    """Two lines as far apart as the threshold allows share an entry, and entries are fewer than lost pairs + 1."""
    rng = np.random.default_rng(3)
    entered = worst = 0
    for n in (4, 5, 9, 10, 15, 21, 40, 60, 100) * 40:
        x = rng.integers(0, rng.choice([4, 30, 5000]), n).astype(np.uint64)
        y, most = x.tolist(), int(lines.edits(n, 0.8))
        for at in sorted(rng.choice(n, most, replace=False).tolist(), reverse=True):
            new = int(rng.integers(10**6, 10**9))
            y[at : at + 1] = [[new], [], [new, y[at]]][rng.integers(0, 3)]
        y = np.array(y, np.uint64)
        counts = np.bincount((common.mix(x) & np.uint64(lines.SLOTS - 1)).astype(np.int64), minlength=lines.SLOTS)
        h, at = common.mix(np.concatenate([x, y])), np.array([0, len(x), len(x) + len(y)])
        if len(y) < lines.LEAST_FUZZY_WORDS or lines.edit_similarity(h[: len(x)], h[len(x) :]) < 0.8 - 1e-9:
            continue
        pairs, pair_at, _ = lines.rare_pairs(h, at, counts, 0.8)
        assert set(pairs[: pair_at[1]].tolist()) & set(pairs[pair_at[1] :].tolist())
        entered += pair_at[2]
        worst += lines.lost_pairs(np.diff(at), 0.8).sum() + 2
    assert 0 < entered < 0.9 * worst


def test_sketches_rule_out_far_lines_only():
    rng = np.random.default_rng(9)
    a, b = [], []
    for n in (1, 5, 30, 60, 100, 150) * 20:
        x = rng.integers(0, 5000, n)
        y = np.where(rng.random(n) < rng.choice([0.1, 0.2, 0.5]), rng.integers(0, 5000, n), x)[: n - rng.integers(0, n // 10 + 1)]
        a.append(" ".join(f"w{i}" for i in x))
        b.append(" ".join(f"w{i}" for i in y))
    left, right = (
        next(lines._sketched(iter([pa.RecordBatch.from_pydict({"node": list(range(len(x))), "text": x})]))) for x in (a, b)
    )
    names = {"a": left["node"], "b": left["node"], "n_a": left["n"], "n_b": right["n"]}
    names |= {"sketch_a": left["sketch"], "sketch_b": right["sketch"]}
    kept = {r for x in lines._likely(0.8)(iter([pa.RecordBatch.from_pydict(names)])) for r in x["a"].to_pylist()}
    u, v = common.batch_words(pa.array(a)), common.batch_words(pa.array(b))
    alike = set(np.flatnonzero(lines.alike(u.hashes(), u.at, v.hashes(), v.at, 0.8)).tolist())
    assert alike <= kept and len(kept - alike) < 0.2 * (len(a) - len(alike))


def test_places_of_shared_pairs_rule_out_lines():
    """Lines of random words that hold a pair at far places are not close; alike lines always are."""
    rng = np.random.default_rng(2)
    close, counts = lines._close(0.8), np.zeros(lines.SLOTS, np.int64)

    def entered(x, y):
        h, at = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
        pairs, pair_at, place = lines.rare_pairs(h, at, counts, 0.8)
        tag, n = lines.parity(h, at).view(np.int64), np.minimum(np.diff(at), lines.MOST_N)
        first, second = (dict(zip(pairs[a:b].tolist(), place[a:b].tolist(), strict=True)) for a, b in ((0, pair_at[1]), (pair_at[1], None)))
        both = first.keys() & second.keys()
        one = [close(tag[:1], n[:1] << 8 | first[g], tag[1:], n[1:] << 8 | second[g])[0] for g in both]
        return any(one), len(both)

    for n in (6, 20, 90, 150, 254, 255, 300) * 12:
        x = rng.integers(0, 1 << 62, n).astype(np.uint64)
        y = x.copy()
        for _ in range(int(0.2 * n)):
            at, kind = rng.integers(0, len(y)), rng.integers(0, 3)
            new = rng.integers(0, 1 << 62, dtype=np.uint64)
            y = np.insert(y, at, new) if kind == 0 else np.delete(y, at) if kind == 1 else np.concatenate([y[:at], [new], y[at + 1 :]])
        if lines.edit_similarity(x, y) >= 0.8 - 1e-9:
            assert entered(x, y)[0]
    shared = []
    for _ in range(100):
        x, y = rng.integers(0, 1 << 62, (2, 150)).astype(np.uint64)
        y[120:122] = x[5:7]
        shared.append(entered(x, y))
    assert any(n for _, n in shared) and not any(found for found, _ in shared)


def test_close_links_finds_chains(spark):
    """A link between followers of two leads is found although neither meets the other's lead."""
    members = spark.createDataFrame(
        [(1, n, t, 5) for n, t in ((1, 0), (2, 0), (3, 1), (4, 1))] + [(2, 9, 0, 5)],
        "bucket bigint, node bigint, tag bigint, n bigint",
    )

    def verify(pairs):
        return pairs.filter("concat(a, b) IN (12, 34, 23)")

    def close(tag, n, other_tag, other_n):
        return np.abs(tag - other_tag) <= 1

    got = {r["node"]: r["root"] for r in links.close_links(members, verify, close).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}


def test_buckets_are_whole_over_batches():
    rng = np.random.default_rng(4)
    bucket = np.sort(np.concatenate([rng.integers(0, 40, 150), np.full(90, 7), np.full(60, 41)]))
    node = np.arange(len(bucket)) // 2  # some nodes twice
    cols = [pa.array(bucket), pa.array(node), pa.array(node), pa.array(node)]
    whole = pa.RecordBatch.from_arrays(cols, names=links.NAMES)
    size = Counter(b for b, _ in set(zip(bucket.tolist(), node.tolist(), strict=True)))
    want = {(b, n) for b, n in zip(bucket.tolist(), node.tolist(), strict=True) if size[b] > 1}
    for step in (300, 7, 1):
        parts = links._whole_buckets((whole.slice(i, step) for i in range(0, len(bucket), step)), links.NAMES)
        got = [(int(b), int(n)) for part in parts for b, n in zip(part[0], part[1], strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_contaminated(spark):
    rng = random.Random(8)
    items = [sentence(rng, n) + f" end{n}" for n in (5, 7, 16, 17, 40, 100, 300)] + ["too short", "", None]
    docs = [sentence(rng, rng.choice([3, 50, 400])) for _ in range(30)]
    for k, item in enumerate(items[:7]):
        w = item.split(" ")
        docs.append(sentence(rng, 900) + " " + item.upper().replace("É", "é") + " " + sentence(rng, 900))
        docs.append(sentence(rng, 60) + " " + " ".join(w[: len(w) * 9 // 10]) + " " + sentence(rng, 50))
        docs.append(sentence(rng, 60) + " " + " ".join(w[: len(w) // 2]))
        docs.append(item)
    docs += [None, "", items[4] * 1, sentence(rng, 20_000) + " " + items[5]]
    bench = spark.createDataFrame(
        [*enumerate(items), (None, items[0]), (0, items[0])], "item_id bigint, text string"
    )
    frame = table(spark, docs)
    got = {(r["doc_id"], r["item_id"], r["shared"]) for r in decontam.contaminated(frame, bench).collect()}
    want = set()
    for i, d in enumerate(docs):
        own = shingles(d)
        for k, item in enumerate(items):
            s = shingles(item)
            if s and len(s & own) >= 0.8 * len(s) - 1e-9:
                want.add((i, k, len(s & own)))
    assert got == want and len(want) > 15
    kept = {r["doc_id"] for r in decontam.decontaminate(frame, bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _, _ in want}
    assert decontam.contaminated(table(spark, []), bench).count() == 0
    assert decontam.contaminated(frame, bench.limit(0)).count() == 0


def test_decontaminate_without_ids(spark):
    item = " ".join(f"item{i}" for i in range(20))
    docs = table(spark, [f"x {item}", "fine text", f"y {item} z", "fine text"], ids=[None, None, 3, 4])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = decontam.decontaminate(docs, bench)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, "fine text"), (4, "fine text")]


def test_shortest_items_are_found(spark):
    """Items of one to ten shingles, whole within long documents."""
    rng = random.Random(23)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(5 + k % 10)) for k in range(600)]
    docs = []
    for k in range(0, len(items), 4):
        rest = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
        docs.append(" ".join(x for pair in zip(rest, [*items[k : k + 4], ""]) for x in pair))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table(spark, docs), bench).collect()}
    assert got == {(k // 4, k) for k in range(len(items))}


@pytest.mark.parametrize(
    "weights",
    [
        {"a": 1, "b": 1},
        {"a": 7, "b": 2, "c": 1},
        {"a": 0.4996, "b": 0.5, "c": 0.0004},
        {"a": 2**0.5, "b": 3**0.5, "c": 0.1, "d": 1e-3},
        {"hot": 2500.0} | {f"s{i:04d}": 1.0 for i in range(500)},
    ],
)
def test_schedule_is_fair(weights):
    """Windows and a deviation of less than one block, from the exact targets, after every slot."""
    share = mixing.shares(weights)
    n = 3000
    blocks = {s: n for s in share}  # no source ends
    taken = Counter()
    watched = sorted(share, key=lambda s: -share[s])[:4] + sorted(share)[:3]
    for t, (s, j) in zip(range(1, n + 1), mixing.schedule(blocks, share)):
        assert j == taken[s]
        assert floor(j / share[s]) <= t - 1 and t <= ceil((j + 1) / share[s])
        taken[s] += 1
        assert all(abs(taken[x] - t * share[x]) < 1 for x in watched)
    assert all(abs(taken[x] - n * share[x]) < 1 for x in share)


def test_schedule_goes_on_when_sources_end():
    share = mixing.shares({"a": 5, "b": 3, "c": 2})
    blocks = {"a": 10, "b": 40, "c": 40}
    order = [s for s, _ in mixing.schedule(blocks, share)]
    assert Counter(order) == blocks
    last = max(i for i, s in enumerate(order) if s == "a")
    rest = Counter()
    for t, s in enumerate(order[last + 1 : last + 41], 1):
        rest[s] += 1
        assert abs(rest["b"] - 0.6 * t) < 2
    assert list(mixing.schedule({}, {})) == []
    with pytest.raises(ValueError, match="positive"):
        mixing.shares({"a": 0.0})


def test_mixing(spark, monkeypatch):
    sources = ["hot"] * 500 + ["b"] * 130 + ["c"] * 64 + [None] * 3 + ["d"]
    docs = table(spark, ["t"] * len(sources), sources=sources)
    docs = docs.selectExpr("*", "source AS _source", "'x' AS rank", "'y' AS _salt", "'z' AS doc", "1 AS mix_slot")
    given = {"hot": 5, "b": 3, "c": 2}
    for most, rows in ((mixing.SLOTS, 8), (40, 18)):  # longer blocks where there would be too many
        monkeypatch.setattr(mixing, "SLOTS", most)
        got = mixing.mix_sources(docs, given, block_rows=8).collect()
        got.sort(key=lambda r: r["mix_position"])
        assert [r["mix_position"] for r in got] == list(range(len(sources)))
        assert all(r["_source"] == r["source"] and (r["rank"], r["_salt"], r["doc"]) == ("x", "y", "z") for r in got)
        order = []
        for r in got:
            if not order or order[-1][0] != r["mix_slot"]:
                order.append((r["mix_slot"], r["source"] or "", r["mix_block"]))
        assert [s for s, _, _ in order] == list(range(len(order)))
        blocks = {s or "": -(-n // rows) for s, n in Counter(sources).items()}
        share = mixing.target_weights({s: 1 for s in blocks}, given, 0.5)
        assert [(s, b) for _, s, b in order] == list(mixing.schedule(blocks, share))
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_language(spark):
    rng = random.Random(6)
    own = {
        "en": "the and of with that this from have they would there which".split(),
        "de": "der und die nicht mit eine auch werden über zwischen können".split(),
        "fr": "le et les dans pour que avec être cette leur où même".split(),
    }
    texts, langs = [], []
    for i in range(150):
        lang = rng.choice(list(own))
        texts.append(" ".join(rng.choice(own[lang]) for _ in range(rng.randrange(5, 60))))
        langs.append(lang if i % 7 else None)
    truth = list(langs)
    mixed = " ".join(rng.choice(own["en"]) for _ in range(40)) + " " + " ".join(rng.choice(own["de"]) for _ in range(60))
    texts += [mixed, None, "", "123 ... ½", "the " * 30_000]
    langs += ["de", None, "en", "fr", "en"]
    docs = table(spark, texts, langs)
    got = {r["doc_id"]: r for r in langid.predict_language(docs).collect()}
    for i, lang in enumerate(truth):
        held = zlib.crc32(str(i).encode()) % 5 == 0
        assert got[i]["held_out"] == held
        assert lang is None or got[i]["lang_pred"] == lang
    n = len(truth)
    assert got[n]["lang_pred"] == "de" and 0.5 < got[n]["score"] < 0.7
    for k in (1, 2, 3):
        assert (got[n + k]["lang_pred"], got[n + k]["score"]) == ("und", 0.0)
    assert got[n + 4]["lang_pred"] == "en" and got[n + 4]["n_words"] == 30_000
    runs = langid.label_documents(docs.filter(f"doc_id = {n}"), langid.fit(docs)).first()["runs"]
    assert [r["lang"] for r in runs] == ["en", "de"] and [r["words"] for r in runs] == [40, 60]
    kept = langid.keep_known_language(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(n)) | {n, n + 4}
    assert langid.predict_language(table(spark, [])).count() == 0
    none = langid.predict_language(table(spark, ["some words"], [None])).first()
    assert (none["lang_pred"], none["score"]) == ("und", 0.0)


def test_mixed_and_unlabelled_texts_stay(spark):
    rng = random.Random(31)
    own = {
        "en": "the and of with that this from have they would there which".split(),
        "de": "der und die nicht mit eine auch werden über zwischen können".split(),
        "fr": "le et les dans pour que avec être cette leur où même".split(),
    }
    langs = [rng.choice(list(own)) for _ in range(120)]
    texts = [" ".join(rng.choice(own[x]) for _ in range(40)) for x in langs]
    parts = [(x, n) for x, n in (("en", 40), ("de", 30), ("fr", 30))]
    texts.append(" ".join(rng.choice(own[x]) for x, n in parts for _ in range(n)))
    texts += ["...", None]
    docs = table(spark, texts, [*langs, None, None, None])
    assert {r["doc_id"] for r in langid.keep_known_language(docs).collect()} == set(range(121))
    bare = table(spark, texts, [None] * len(texts))
    assert {r["doc_id"] for r in langid.keep_known_language(bare).collect()} == set(range(121))


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    labels = ["a", "b", "c"]
    crf = langid.Crf(labels, {}, np.zeros(3), rng.normal(size=(3, 3)), rng.normal(size=3), np.zeros(0, np.uint64))
    sizes = [3, 0, 1, 4]
    at = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(at[-1], 3)).astype(np.float32)
    got = langid.forward_backward(crf, scores, at)
    for i, n in enumerate(sizes):
        if not n:
            continue
        weight = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            s = crf.begin[path[0]] + sum(scores[at[i] + t, y] for t, y in enumerate(path))
            s += sum(crf.step[a, b] for a, b in zip(path, path[1:]))
            for t, y in enumerate(path):
                weight[t, y] += np.exp(s)
        assert np.allclose(got[at[i] : at[i + 1]], weight / weight.sum(1, keepdims=True), atol=1e-4)


def test_crf_gradient():
    """The analytic gradient against differences of the log-likelihood."""
    rows = [("a", ["xa", "xb", "xa"]), ("b", ["yb", "ya", "xa", "yb"])]
    crf = langid.train(rows, epochs=1)
    batch = [(w, [{"a": 0, "b": 1}[x]] * len(w)) for x, w in rows]

    def loss():
        total, n = 0.0, 0
        for w, ys in batch:
            e = crf.emissions(w).astype(float)
            s = crf.begin[ys[0]] + sum(e[t, y] for t, y in enumerate(ys))
            s += sum(crf.step[a, b] for a, b in zip(ys, ys[1:]))
            z = crf.begin + e[0]
            for t in range(1, len(w)):
                z = np.log(np.exp(z[:, None] + crf.step).sum(0)) + e[t]
            total -= s - np.log(np.exp(z).sum())
            n += len(w)
        return total / n

    grads = langid._gradient(crf, batch)
    for name, array in (("step", crf.step), ("begin", crf.begin), ("bias", crf.bias)):
        for spot in np.ndindex(array.shape):
            old = array[spot]
            array[spot] = old + 1e-2
            up = loss()
            array[spot] = old - 1e-2
            down = loss()
            array[spot] = old
            assert grads[name][spot] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_lm(spark, texts):
    got = {r["doc_id"]: r for r in lm.lm_scores(table(spark, texts)).collect()}
    counts = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        w = [*words(t), "\n"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0
    assert lm.lm_scores(table(spark, [])).count() == 0


def test_lm_is_normalised():
    model = lm.LogBilinear.fresh(np.arange(lm.CLASSES) + 1.0)
    vocab = lm.Vocabulary([lm.END], np.ones(1), np.zeros(1, int), 1, 1, np.ones(lm.CLASSES), np.ones(lm.CLASSES))
    s = lm.Scorer.of(vocab, model)
    every = np.arange(lm.CLASSES)
    for a, b in ((0, 0), (5, 200), (383, 17)):
        p = 10 ** s.class_scores(every, np.full_like(every, a), np.full_like(every, b))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_lm_learns_pairs():
    """After training, a class that always follows another is likelier than its share."""
    rng = np.random.default_rng(3)
    y = np.empty(60_000, int)
    y[0::2] = rng.integers(0, 50, 30_000)
    y[1::2] = y[0::2] + 50
    before, second = np.roll(y, 1), np.roll(y, 2)
    share = np.bincount(y, minlength=lm.CLASSES) + 0.0
    model = lm.LogBilinear.fresh(share)
    memory = [np.full(p.shape, lm.CALM) for p in model.parts()]
    noise = (share + 0.5) / (share + 0.5).sum()
    for _ in range(12):
        order = rng.permutation(len(y))
        for lo in range(0, len(y) - lm.BATCH, lm.BATCH):
            k = order[lo : lo + lm.BATCH]
            lm.contrast(model, noise, y[k], before[k], second[k], rng, memory)
    vocab = lm.Vocabulary([lm.END], np.ones(1), np.zeros(1, int), 1, 1, share, share)
    got = lm.Scorer.of(vocab, model).class_scores(y, before, second)[1::2].mean()
    assert got > np.log10(noise[y])[1::2].mean() + 0.5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head>
<body class="with-sidebar"><header><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>{long}</p></div><div class="ad">Buy the thing of the day and be happy.</div>
{main}
<div id="sidebar"><p>{long}</p></div><section class="comments"><p>{long}</p></section>
<form><p>{long}</p><input name="q"></form><footer>&copy; 2020 {long}</footer></body></html>"""
LONG = "It is the story of a man who went to the sea and of what he saw there, as it was told to us. " * 3


def test_page_in_article():
    main = f"<article><h1>A &amp; B</h1><p>{LONG}<p>Short  one&nbsp;here.<br>More</p><script>x()</script><p>{LONG}</article>"
    text, _, _ = pagetext.main_text(PAGE.format(long=LONG, main=main))
    line = " ".join(LONG.split())
    assert text == f"A & B\n\n{line}\n\nShort one here. More\n\n{line}"


def test_page_without_article():
    main = f"<div class='wrap'><h2>Title</h2><p>{LONG}</p><p>It is short.</p><p>{LONG}</p></div><div><a href='x'>more</a> <a href='y'>links and names</a></div>"
    text, _, _ = pagetext.main_text(PAGE.format(long=LONG, main=main))
    line = " ".join(LONG.split())
    assert text == f"Title\n\n{line}\n\nIt is short.\n\n{line}"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<a href='", "<!-- open", "<script>never closed", "<nav><p>x"])
def test_broken_pages(page):
    text, _, _ = pagetext.main_text(page)
    assert "script" not in text


def test_pages_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}"), (1, "u", f"<article><p>{LONG}"), (2, None, None), (3, "v", "x&am")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = pagetext.extract_pages(pages).collect()
    assert sorted((r["page_id"], r["n_chars"], len(r["text"])) for r in got) == sorted(
        [(1, len(LONG.strip()), len(LONG.strip()))] * 2 + [(2, 0, 0), (3, 0, 0)]
    )
    assert pagetext.extract_pages(pages.limit(0)).count() == 0


def test_quality(spark, texts):
    rng = random.Random(12)
    good = [sentence(rng, rng.randrange(20, 200)) + "." for _ in range(150)]
    bad = [" ".join([rng.choice(VOCAB)] * 60) for _ in range(40)] + [sentence(rng, 40).replace(" ", "### ") for _ in range(40)]
    docs = table(spark, [*good, *bad, None, "", "x " * 50_000])
    n = len(good) + len(bad)
    rows = [(i, int(i < len(good)), 0) for i in range(n)] + [(10**6, 1, 0), (3, None, 0), (None, 0, 0)]
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    right = sum(got[i]["predicted"] == int(i < len(good)) for i in range(n))
    assert right >= 0.97 * n and len(got) == n + 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert {i for i in got if got[i]["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    empty = quality.score_quality(docs.limit(3), labels.limit(0)).collect()
    assert [r["score"] for r in empty] == [0.5] * 3
    assert quality.score_quality(table(spark, []), labels).count() == 0


def test_text_statistics():
    got = quality.text_statistics(pa.array(["A b B\nc, c,", None, ""]))
    s = dict(zip(quality.STATS, got[0], strict=True))
    assert s["n_words"] == 5 and s["distinct_words"] == 3 / 5 and s["top_word"] == 2 / 5
    assert s["same_as_before"] == 2 / 5 and s["upper"] == 2 / 11 and s["commas"] == 2 / 11
    assert s["lines_per_word"] == 2 / 5 and s["line_repeats"] == 0
    assert not got[1:].any()


def test_rules_describe_themselves():
    rule = quality.Rule((("digits", True, 0.5), ("n_words", False, 3.0)))
    assert str(rule) == "digits > 0.5 and n_words <= 3"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    clean = [sentence(rng, 60) for _ in range(30)]
    near = mutate(rng, clean[0], 0.01)
    item = " ".join(f"item{i}" for i in range(30))
    texts = [*clean, clean[1], near, f"{sentence(rng, 40)}\n{item}", None, "...", ""]
    folder = str(tmp_path)
    table(spark, texts, sources=[f"s{i % 3}" for i in range(len(texts))]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(30))
    assert sorted(r["mix_position"] for r in rows) == list(range(30))
    assert all(r["text"] == clean[r["doc_id"]] for r in rows)


def test_sketches_see_words_that_lines_repeat():
    """Words that lines hold an even number of times left no bit of a parity, so such lines passed as alike."""
    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 1 << 62, (2, 20)).astype(np.uint64).repeat(4, axis=1)
    h, at = np.concatenate([x, y]), np.array([0, 80, 160])
    i, j = np.array([0]), np.array([1])
    assert not lines._may_be_alike(0.8)(np.diff(at), lines.sketches(h, at), i, j)[0]
    assert np.bitwise_count(lines.parity(h, at)[0] ^ lines.parity(h, at)[1]) > 10
    for n in (5, 20, 60, 140) * 30:
        x = rng.integers(0, rng.choice([2, 6, 40]), n).astype(np.uint64)
        y = x.copy()
        for _ in range(int(0.2 * n)):
            place, kind, new = rng.integers(0, len(y)), rng.integers(0, 3), rng.integers(0, 45, dtype=np.uint64)
            y = np.insert(y, place, new) if kind == 0 else np.delete(y, place) if kind == 1 else np.concatenate([y[:place], [new], y[place + 1 :]])
        h, at = common.mix(np.concatenate([x, y])), np.array([0, n, n + len(y)])
        if lines.edit_similarity(h[:n], h[n:]) >= 0.8 - 1e-9:
            assert lines._may_be_alike(0.8)(np.diff(at), lines.sketches(h, at), i, j)[0]
            tag, size = lines.parity(h, at).view(np.int64), np.diff(at) << 8 | lines.ANYWHERE
            assert lines._close(0.8)(tag[:1], size[:1], tag[1:], size[1:])[0]


def test_a_text_is_split_once_not_for_each_line(spark):
    docs = table(spark, ["one two three four five\nsix seven eight nine ten\none two three four five"])
    plan = lines.dedup_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" in plan and not [x for x in plan.split("lambdafunction(")[1:] if "split(" in x.split(")", 1)[0]]


def test_lines_held_very_often_meet_theirs_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["often met line of words\nonly " + sentence(rng, 8) + "\nrare line no " + str(i // 2) for i in range(40)]
    texts += ["often met line of word\nrare line no 3"]
    expected = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table(spark, texts)).collect()}
    monkeypatch.setattr(lines, "OFTEN", 3)
    found = lines.dedup_lines(table(spark, texts))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == expected
    assert sum("often met" in x for x in expected.values()) == 1
    hot = spark.createDataFrame([(1, 1, 9), (2, 2, 2)], "k1 bigint, k2 bigint, times bigint").withColumn("keep", F.lit(0))
    rows = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (2, 2, 7), (3, 3, 8)], "k1 bigint, k2 bigint, doc_id bigint")
    joined = lines._with_stand(rows, hot)
    assert sorted(r["doc_id"] for r in joined.collect()) == [5, 6, 7]
    assert "Broadcast" in joined._jdf.queryExecution().executedPlan().toString()


def test_batches_of_whole_texts_are_small(spark):
    """10,000 texts a batch took tens of megabytes several times a task."""
    before = spark.conf.get(common.BATCH_ROWS)
    try:
        spark.conf.set(common.BATCH_ROWS, "10000")
        common.ship(spark)
        assert int(spark.conf.get(common.BATCH_ROWS)) == common.TEXTS_A_BATCH
        spark.conf.set(common.BATCH_ROWS, "7")
        common.ship(spark)
        assert spark.conf.get(common.BATCH_ROWS) == "7"
    finally:
        spark.conf.set(common.BATCH_ROWS, before)


def test_groups_in_one_bucket_join_without_all_their_pairs(spark, monkeypatch):
    """Close mates whose leads are not alike: every pair across groups was a row once."""
    n = 60
    rows = [(1, i, 0, 0) for i in range(n)]
    members = spark.createDataFrame(rows, "bucket bigint, node bigint, tag bigint, n bigint")
    sizes = []

    def stored(df):
        out = materialize(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(links, "materialize", stored)
    always = lambda tag, n, other_tag, other_n: np.ones(np.broadcast(tag, other_tag).shape, bool)
    alike = lambda pairs: pairs.filter("a > 0")  # noqa: E731  the lead of all is like none
    found = links.close_links(members, alike, always).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 1) for i in range(1, n)}
    assert max(sizes) <= n + n
