"""Token alignment against a plain version that compares every pair of tokens of a text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest

from tillwise.llm import align
from tillwise.llm.queries import op11_token_alignment

TEXTS = [
    None,
    "",
    " ",
    "   two  spaces and a tab\tor\n\n two lines \r\n",
    "The tokenizers' ends, aren't shared everywhere: naïveté, Übermaß, 東京タワー, 😀👍🏽, \u00a0\u2003x",
    "a\u2581b has the piece's own space sign",
    "<s> </s> <unk> <|endoftext|> stay text, <0x0A> too",
    "1234567890 3.14159 0x1F " * 20,
    "x" * 3000,
    "\x00\x01 control",
    "e\u0301 combining and \u200d joiner",
    " " * 2000 + "end",
    "ab" * 80_000,
]


def plain(rows, a, b):
    """Expected rows, by looking at all pairs of tokens."""
    out, links = {}, {}
    for key, text in rows:
        raw = b" " + (text or "").encode()
        ids = [a.coder.encode([" " + text])[0].tolist(), b.coder.encode([text])[0].tolist()] if text else [[], []]
        if text and any(t.joined(np.array(i)) != raw for t, i in zip((a, b), ids, strict=True)):
            ids = [[], []]
        spans = [list(pairwise(np.cumsum([0, *[len(t.coder.bytes[i]) for i in i_]]).tolist())) for t, i_ in zip((a, b), ids)]
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in shared:
            inside = [[str(i) for i, (s, e) in zip(i_, sp) if start <= s and e <= end] for i_, sp in zip(ids, spans)]
            groups.append(",".join(inside[0]) + "|" + ",".join(inside[1]))
            start = end
        found = []
        if len(ids[0]) < 3000:
            for i, (s, e) in zip(ids[0], spans[0]):
                found += [(i, j) for j, (u, v) in zip(ids[1], spans[1]) if s < v and u < e]
        links[key] = found
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out[key] = (len(ids[0]), len(ids[1]), len(groups), len(found), digest)
    counts = Counter(pair for f in links.values() for pair in f)
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return {
        k: (*v[:4], sum(counts[p] == top[p[1]] for p in links[k]), sum(counts[p] for p in links[k]), v[4])
        for k, v in out.items()
    }


@pytest.fixture(scope="module")
def tables():
    return align._tables(align.TOKENIZERS, align.BYTE_LEVEL, align.PIECES)


def rows_of(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("share", [align.FREQUENT_SHARE, 1.0, 0.002])
def test_alignment(spark, tables, share):
    """With all pairs, no pair and some pairs looked up from memory."""
    rng = random.Random(7)
    words = "the of and Haus maison niño running antidisestablishment 42 x, (y) don't".split(" ")
    texts = TEXTS[:-1] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string, _row int").repartition(3)
    got = rows_of(align.alignment(docs, frequent_share=share))
    assert got == plain([(r[0], r[1]) for r in rows], *tables)
    assert got[0][-1] == got[1][-1] == "" and got[5][0] == 0 and got[6][0] > 0


def test_query_over_whole_documents(spark, tables):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(op11_token_alignment(spark, folder))
    want = plain([tuple(r) for r in docs], *tables)
    small = {k for k, v in want.items() if v[0] < 3000}
    assert len(small) > 150 and set(got) == set(want)
    for k in want:  # links of longer texts are counted but not listed by the plain version
        assert got[k][:3] == want[k][:3] and got[k][-1] == want[k][-1]
    assert all(got[k][3] == want[k][3] for k in small)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(None, "same text here"), (None, "same text here"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = align.alignment(docs).collect()
    assert sorted((r["n_a"], r["count_sum"]) for r in got) == [(0, 0), (3, 6), (3, 6)]
    assert align.alignment(docs.limit(0)).count() == 0


def test_a_very_long_run_is_aligned(tables):
    got = align.align_texts(["ab" * 80_000, "long " * 1000], *tables)
    assert got["n_links"].to_pylist()[0] > 0 and min(got["n_groups"].to_pylist()) > 0


def test_fast_and_slow_encoding_agree(tables):
    coder = tables[0].coder
    for text in TEXTS:
        if text:
            ids = coder.slow.encode(" " + text, add_special_tokens=False).ids
            assert coder.encode([" " + text])[0].tolist() == ids


def test_shared_cuts_are_found_wherever_they_lie():
    rng = np.random.default_rng(5)
    for share in (0.0, 0.05, 0.5, 1.0):
        at_a, at_b, a, b, base = [0], [0], [], [], 0
        for _ in range(30):
            n = int(rng.integers(1, 200))
            common = set(rng.choice(n, int(n * share), replace=False).tolist()) | {n}
            one = sorted(common | set(rng.choice(n, n // 3, replace=False).tolist()))
            two = sorted(common | set(rng.choice(n, n // 3, replace=False).tolist()))
            a += [base + v for v in one]
            b += [base + v for v in two]
            base += n + 1
            at_a.append(len(a))
            at_b.append(len(b))
        a, b = np.array(a), np.array(b)
        cut_a, cut_b = align.shared_cuts(a, b, np.array(at_a), np.array(at_b))
        assert (cut_a == np.isin(a, b)).all() and (cut_b == np.isin(b, a)).all()
