"""Personal data: base spans against a plain version, further kinds, edge cases."""

from __future__ import annotations

from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brute import base_digest, base_spans
from pyspark.sql import functions as F

from tillwise.llm import pii

FOLDER = "/root/testdata/sf0.01"

CASES = [
    None,
    "",
    "no data at all",
    "a@b.c_d@e.f and x@y..z, p@q.r.s.t",
    "1.2.3.4 256.1.1.1 0001.2.3.255 1.2.3.4.5.6.7.8.9",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111 1111 1111 1111 2",
    "+49 (0)30 1234567. or +1.2.3 then +1+2 +123456789012345678",
    "é😀 é a.b@c.de 😀 10.0.0.1 ö 5500005555555559",
    "12 34 56 78 90 12 34 56" * 3,
    "@@@ .@. +.+ 1.1.1",
    "IBAN DE89 3704 0044 0532 0130 00 ok, DE88 3704 0044 0532 0130 00 not",
    "my ssn is 123-45-6789. number 123-45-6789",
    "9" * 50_000 + "." + "a" * 50_000 + "@" + "b." * 20_000 + "c",
]


def run(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found string")
    return {r["doc_id"]: r for r in pii.pii_report(docs).collect()}


def test_base_spans(spark):
    got = run(spark, CASES)
    for i, text in enumerate(CASES):
        spans = base_spans(text)
        assert got[i]["base_sha256"] == base_digest(text), text[:80]
        for n, name in enumerate(pii.BASE):
            assert got[i][f"n_{name}"] == sum(k == n for _, k, _ in spans)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("ab1.@+-() 9é😀", max_size=60), min_size=40, max_size=80))
def test_random_texts(spark, texts):
    got = run(spark, texts)
    for i, text in enumerate(texts):
        assert got[i]["base_sha256"] == base_digest(text), text


def test_further_kinds(spark):
    got = run(spark, CASES)
    assert "iban:5:32" in got[10]["spans"] and got[10]["spans"].count("iban") == 1
    assert got[11]["spans"].startswith("ssn:10:21")


def test_redact(spark):
    docs = spark.createDataFrame([(1, "to a@b.c now"), (2, None)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()} == {1: "to [email] now", 2: ""}


def test_empty_table(spark):
    assert pii.pii_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r["base_sha256"] for r in pii.pii_report(docs).collect()}
    want = {r["doc_id"]: base_digest(r["text"]) for r in docs.collect()}
    assert got == want


def test_running_totals_of_any_length(spark):
    for n in (1, 2, 255, 256, 257, 1000):
        steps = F.array(*[F.lit(i % 7) for i in range(n)])
        got = spark.range(1).select(pii.running(steps).alias("t")).first()["t"]
        assert got == [sum(j % 7 for j in range(i + 1)) for i in range(n)]


def test_very_many_spans(spark):
    """All spans of a text with thousands of them, and context words found between neighbours."""
    text = " ".join(f"mail me{i}@site.org or" if i % 2 else f"+49 30 12345{i:05d}," for i in range(6000))
    row = run(spark, [text])[0]
    assert (row["n_email"], row["n_phone"]) == (3000, 3000) and row["base_sha256"] == base_digest(text)
    docs = spark.createDataFrame([(0, "mail a@b.cc," * 40 + " x@y.zz" + "," * 48 + "mail")], "doc_id bigint, text string")
    scores = [round(s["score"], 6) for s in pii.find_pii(docs).first()["found"]]
    assert scores == [1.0] * 41
    far = spark.createDataFrame([(0, "mail" + "." * 49 + " x@y.zz" + "," * 49 + "mail")], "doc_id bigint, text string")
    assert [s["score"] for s in pii.find_pii(far).first()["found"]] == [0.9]
