"""Review scores against churn."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import as_date, ratio_round
from tillwise.functions.numeric import pearson
from tillwise.operators.skew import spread_join
from tillwise.params import DEFAULTS


def review_churn(
    reviews: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    ref_date: Column | dt.date | str,
    threshold: int = DEFAULTS.churn_high_days,
) -> DataFrame:
    """One row per review: customer, days since that order, churn flag.

    Reviews and orders are unique per order_id, so recency is that of the
    reviewed order.  Orders of hot customers are spread for the customer join.
    """
    owned = spread_join(
        orders.select("order_id", "customer_id", "order_purchase_timestamp"),
        customers.select("customer_id", "customer_unique_id"),
        "customer_id",
        ["order_id"],
    )
    bought = F.col("order_purchase_timestamp")
    recency = F.datediff(as_date(ref_date), bought.cast("date"))
    return reviews.join(owned, "order_id").select(
        "order_id",
        "review_score",
        "order_purchase_timestamp",
        "customer_unique_id",
        recency.alias("recency_days"),
        F.when(recency > threshold, 1).otherwise(0).alias("churned"),
    )


def sentiment_of(score: Column) -> Column:
    """(0,2] Negative, (2,3] Neutral, (3,5] Positive, else NULL."""
    return (
        F.when((score > 0) & (score <= 2), "Negative")
        .when((score > 2) & (score <= 3), "Neutral")
        .when((score > 3) & (score <= 5), "Positive")
    )


def sentiment_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("sentiment_label", sentiment_of(F.col("review_score")))


def churn_by_sentiment(labelled: DataFrame) -> DataFrame:
    """Churn rate (4 digits), reviews, and the rate in percent (1 digit) per sentiment."""
    n, churned = F.count("churned"), F.sum("churned")
    rate = ratio_round(churned, n, 4)
    return (
        labelled.filter(F.col("sentiment_label").isNotNull())
        .groupBy("sentiment_label")
        .agg(
            rate.alias("churn_rate"),
            n.alias("count"),
            # ten-thousandths of the rounded rate to tenths of a percent
            ratio_round(F.rint(rate * 10000).cast("bigint"), 100, 1).alias("churn_pct"),
        )
        .orderBy("sentiment_label")
    )


def sentiment_gap(by_sentiment: DataFrame) -> DataFrame:
    """Churn percent of Negative and Positive and their difference."""

    def pct(label: str) -> Column:
        return F.max(F.when(F.col("sentiment_label") == label, F.col("churn_pct")))

    gap = F.round(pct("Negative") - pct("Positive"), 1)
    return by_sentiment.agg(
        pct("Negative").alias("negative_pct"),
        pct("Positive").alias("positive_pct"),
        gap.alias("gap_pp"),
    )


def sentiment_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("count"))


def score_churn_corr(df: DataFrame) -> DataFrame:
    return df.agg(pearson(F.col("review_score"), F.col("churned")).alias("corr"))


def score_histogram(df: DataFrame) -> DataFrame:
    counts = df.filter(F.col("review_score").isNotNull()).groupBy("review_score")
    return counts.agg(F.count(F.lit(1)).alias("count")).orderBy("review_score")
