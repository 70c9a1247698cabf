"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import text_or_empty
from tillwise.session import materialize

PREFIX = 256
SALTS = 32


def _grouped_again(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows whose ``keys`` occur more than once.

    Counts are taken before the join, so only keys that repeat go into it; they are repeated per
    salt and the rows of a key are spread over its salts, so a key with a third of all rows is not
    one task.
    """
    repeated = rows.groupBy(*keys).agg(F.count("*").alias(count)).filter(F.col(count) > 1)
    salted = repeated.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*keys, "_salt"]).drop("_salt")


def exact_groups(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, keep_id, group_size, text_sha256) of documents that have an equal text elsewhere.

    Texts are compared as they are; null counts as empty.  Of equal texts the row with the largest
    doc_id stays; a doc_id that occurs twice with one text counts twice in ``group_size``.
    1. Rows are grouped by length; 2. rows of repeated lengths by length and hash of their first
    ``prefix`` characters; 3. the text of rows that are left is read again in full and hashed.
    Lengths and prefix hashes are stored once, so the first two rounds move three small columns.
    An empty table, and a table of different texts, give no rows.
    """
    text = text_or_empty(docs)
    prints = materialize(
        docs.select(
            "doc_id",
            F.octet_length(text).alias("n"),
            F.xxhash64(F.substring(text, 1, prefix)).alias("p"),
        )
    )
    same_length = _grouped_again(prints, ["n"], "c")
    survivors = _grouped_again(same_length, ["n", "p"], "c").select("doc_id").distinct()
    full = materialize(
        docs.select("doc_id", text.alias("text"))
        .join(survivors.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        .select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    )
    groups = full.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    ).filter("group_size > 1")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = full.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return spread.join(salted, ["text_sha256", "_salt"]).select(
        "doc_id", "keep_id", "group_size", "text_sha256"
    )


def digest(docs: DataFrame) -> Column:
    """Lower-case hex SHA-256 of the text as UTF-8; null counts as empty."""
    return F.sha2(text_or_empty(docs), 256)


def exact_dedup(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Documents without an equal text are their own group of size 1.  Rows are matched by doc_id and
    digest, so a doc_id that occurs with different texts keeps a row for each.  A row without doc_id
    yields to equal texts that have one; if none has, keep_id is null and all of them are kept.
    """
    names = {"doc_id": "_id", "text_sha256": "_sha"}
    found = exact_groups(docs, prefix).distinct().withColumnsRenamed(names)
    every = docs.select("doc_id", digest(docs).alias("text_sha256"))
    keep = F.coalesce("keep_id", "doc_id")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha"))
    return every.join(found, same, "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(keep == F.col("doc_id"), keep.isNull()).alias("kept"),
        "text_sha256",
    )


# The same rows in DuckDB's SQL.
SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, g.keep_id IS NULL) AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
