"""One query per operator over its whole table, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwise.llm import (
    align,
    decontam,
    exact,
    jaccard,
    langid,
    lines,
    lm,
    mixing,
    pagetext,
    pii,
    quality,
    search,
    urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predict_language(_table(spark, folder, "documents"))


def op2_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.lm_scores(_table(spark, folder, "documents"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs)


def op5_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pagetext.extract_pages(_table(spark, folder, "pages"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, folder, "documents"))


def op7_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_classes(_table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(
        _table(spark, folder, "documents"), _table(spark, folder, "labels")
    )


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_report(_table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return align.alignment(_table(spark, folder, "documents"))


def op12_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(_table(spark, folder, "pages"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.lexical_search(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


def queries() -> dict[str, Query]:
    return {
        "op1_language_id": op1_language_id,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_line_dedup": op3_line_dedup,
        "op4_source_mixing": op4_source_mixing,
        "op5_html_extraction": op5_html_extraction,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_quality": op8_quality,
        "op9_pii": op9_pii,
        "op10_decontamination": op10_decontamination,
        "op11_token_alignment": op11_token_alignment,
        "op12_url_filter": op12_url_filter,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": exact.SQL,
        "op10_decontamination": decontam.SQL,
        "op13_lexical_search": search.SQL,
    }
