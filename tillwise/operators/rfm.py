"""Recency, frequency and monetary value: base, scores, segments, summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import as_date, cents, money, ratio_round
from tillwise.operators.grain import customer_orders
from tillwise.operators.ranking import ntile_distributed, tile_boundaries, with_tiles
from tillwise.params import DEFAULTS
from tillwise.session import materialize


def rfm_base(
    customers: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    as_of: Column | dt.date | str,
    by_place: bool = False,
) -> DataFrame:
    """Per customer: days since the last order, number of orders, money spent.

    ``by_place`` is the form of the analysis query: it adds city and state to
    the key and leaves out orders without purchase time.
    """
    recency = F.datediff(as_date(as_of), F.col("last_purchase").cast("date"))
    figures = [
        recency.alias("recency_days"),
        F.col("n_orders").alias("frequency"),
        money("pay").alias("monetary"),
    ]
    if not by_place:
        totals = customer_orders(customers, orders, payments)
        return totals.select("customer_unique_id", *figures)
    # One key column keeps the plan of customer_orders: a struct of id and place.
    key = F.struct("customer_unique_id", "customer_city", "customer_state")
    placed = customers.select("customer_id", key.alias("customer_unique_id"))
    dated = orders.filter(F.col("order_purchase_timestamp").isNotNull())
    totals = customer_orders(placed, dated, payments)
    return totals.select("customer_unique_id.*", *figures)


def _bands() -> dict[str, tuple[Column, bool]]:
    return {
        "r_score": (F.col("recency_days").cast("bigint"), False),
        "f_score": (F.col("frequency").cast("bigint"), True),
        "m_score": (cents("monetary"), True),
    }


def score_boundaries(base: DataFrame, k: int = DEFAULTS.score_bands) -> DataFrame:
    """Where the bands of ``rfm_scored`` begin, to be stored and passed to it later."""
    return tile_boundaries(materialize(base), k, _bands(), "customer_unique_id")


def rfm_scored(
    base: DataFrame,
    k: int = DEFAULTS.score_bands,
    five_is_best: bool = False,
    boundaries: DataFrame | None = None,
) -> DataFrame:
    """Adds r_score, f_score, m_score: k bands of equal size, ties by customer.

    By default band 1 holds the best customers; ``five_is_best`` turns the bands
    round so that the segment names fit.  With stored ``boundaries`` nothing runs
    before the result is asked for, and bands are those of the rows they were taken from.
    """
    if boundaries is not None:
        scored = with_tiles(base, boundaries, _bands(), "customer_unique_id")
    else:
        scored = ntile_distributed(materialize(base), k, _bands(), "customer_unique_id")
    if five_is_best:
        scored = scored.withColumns(
            {s: F.lit(k + 1) - F.col(s) for s in ("r_score", "f_score", "m_score")}
        )
    return scored


def segment_of(r: Column, f: Column, m: Column) -> Column:
    """Segment name; the first rule that holds wins."""
    # fixed values: lower bounds of the score sum and the names they give
    total = r + f + m
    return (
        F.when(total >= 13, "Champions")
        .when(total >= 10, "Loyal Customers")
        .when(total >= 7, "Potential Loyalists")
        .when((r >= 4) & (f + m <= 4), "New Customers")
        .when((r <= 2) & (f + m >= 8), "At Risk")
        .otherwise("Need Attention")
    )


def rfm_segments(scored: DataFrame) -> DataFrame:
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.withColumn("rfm_avg", ratio_round(r + f + m, 3, 2)).withColumn(
        "segment", segment_of(r, f, m)
    )


def rfm_summary(segments: DataFrame) -> DataFrame:
    """Per segment: customers, average recency, frequency and spend, revenue."""
    n, spent = F.count(F.lit(1)), F.sum(cents("monetary"))
    return (
        segments.groupBy("segment")
        .agg(
            n.alias("customer_count"),
            ratio_round(F.sum("recency_days"), F.count("recency_days")).alias("avg_recency_days"),
            ratio_round(F.sum("frequency"), n, 2).alias("avg_frequency"),
            money(ratio_round(spent, n)).alias("avg_monetary"),
            money(spent).alias("total_revenue"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_first(), "segment")
    )
