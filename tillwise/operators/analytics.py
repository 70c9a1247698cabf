"""Analysis queries: cohorts, trends, categories, sellers, funnel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.functions import as_date, cents, month_start, ratio_round, seconds_between
from tillwise.operators.ranking import top_k
from tillwise.operators.views import late_risk, seller_totals, v_category_performance, v_monthly_revenue
from tillwise.params import DEFAULTS
from tillwise.sources.star import Star


def cohort_retention(
    customers: DataFrame,
    orders: DataFrame,
    start: Column | dt.date | str = DEFAULTS.cohort_start,
    max_month: int = DEFAULTS.cohort_max_month,
) -> DataFrame:
    """Customers of each first-order month who bought again 0..max_month months later.

    A customer is held as the set of months with an order, which is bounded by
    the calendar: the first month and all later ones come from one aggregate,
    with no second join and no distinct count.
    """
    month = month_start("order_purchase_timestamp")
    per_id = orders.groupBy("customer_id").agg(F.collect_set(month).alias("months"))
    active = (
        customers.select("customer_id", "customer_unique_id")
        .join(per_id, "customer_id")
        .select("customer_unique_id", F.explode("months").alias("month"))
        .groupBy("customer_unique_id")
        .agg(F.collect_set("month").alias("months"))
        .select(F.array_min("months").alias("cohort_month"), F.explode("months").alias("month"))
    )
    first, later = F.col("cohort_month"), F.col("month")
    number = (F.year(later) - F.year(first)) * 12 + F.month(later) - F.month(first)
    counted = (
        active.filter(first >= as_date(start))
        .groupBy("cohort_month", number.alias("month_number"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )
    # Months squared at most from here on.
    size = F.max(F.when(F.col("month_number") == 0, F.col("customers"))).over(
        W.partitionBy("cohort_month")
    )
    return (
        counted.withColumn("cohort_size", size)
        .filter(F.col("month_number") <= max_month)
        .select(
            F.date_format("cohort_month", "yyyy-MM").alias("cohort"),
            "month_number",
            "customers",
            "cohort_size",
            ratio_round(F.col("customers") * 100, F.col("cohort_size"), 1).alias("retention_rate"),
        )
        .orderBy("cohort", "month_number")
    )


def revenue_trends(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Revenue per month with the month before and growth in percent."""
    by_month = W.orderBy("month")  # one row per month, so a single task is enough
    monthly = v_monthly_revenue(orders, payments).withColumn("c", cents("revenue"))
    before = F.lag("c").over(by_month)
    return (
        monthly.withColumn("b", before)
        .withColumn("prev_month_revenue", F.lag("revenue").over(by_month))
        .select(
            F.date_format("month", "yyyy-MM").alias("month"),
            "total_orders",
            "unique_customers",
            "revenue",
            "prev_month_revenue",
            ratio_round((F.col("c") - F.col("b")) * 100, F.col("b"), 1).alias("mom_growth_pct"),
        )
        .orderBy("month")
    )


def top_categories(
    star: Star, limit: int = DEFAULTS.top_categories, dedupe_orders: bool = False
) -> DataFrame:
    """Best categories by revenue with their rank.

    The rank of a kept row only depends on rows above it, so it is taken after
    the limit.
    """
    best = top_k(v_category_performance(star, dedupe_orders), "total_revenue", limit, ["category"])
    rank = F.rank().over(W.orderBy(F.col("total_revenue").desc_nulls_first()))
    return best.withColumn("revenue_rank", rank).orderBy("revenue_rank", "category")


def seller_delivery(
    star: Star,
    min_orders: int = DEFAULTS.min_seller_orders,
    high: float = DEFAULTS.late_high_pct,
    medium: float = DEFAULTS.late_medium_pct,
    limit: int = DEFAULTS.top_sellers,
) -> DataFrame:
    """Sellers with the largest share of late deliveries."""
    rated = seller_totals(star, min_orders).withColumn(
        "seller_risk_rating", late_risk(F.col("late_pct"), high, medium)
    )
    return top_k(rated, "late_pct", limit, ["seller_id"])


def order_funnel(orders: DataFrame) -> DataFrame:
    """Stage counts, drop-offs, conversion and mean hours between stages, in one row."""
    bought, approved, shipped, arrived = (
        F.col(c)
        for c in (
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
        )
    )

    def hours(later: Column, earlier: Column) -> Column:
        took = seconds_between(later, earlier)
        micros = (F.sum(took) * 1000000).cast("decimal(28,0)")
        return ratio_round(micros, F.count(took) * 3600000000, 1)

    stages = orders.agg(
        F.count(F.lit(1)).alias("stage_1_placed"),
        F.count(approved).alias("stage_2_approved"),
        F.count(shipped).alias("stage_3_dispatched"),
        F.count(arrived).alias("stage_4_delivered"),
        hours(approved, bought).alias("avg_hours_to_approval"),
        hours(shipped, approved).alias("avg_hours_to_dispatch"),
        hours(arrived, shipped).alias("avg_hours_to_delivery"),
    )
    s1, s2, s3, s4 = (F.col(c) for c in stages.columns[:4])
    tenths = sum(
        F.rint(F.col(c) * 10).cast("bigint")
        for c in ("avg_hours_to_approval", "avg_hours_to_dispatch", "avg_hours_to_delivery")
    )
    return stages.select(
        *stages.columns[:4],
        (s1 - s2).alias("drop_placed_to_approved"),
        (s2 - s3).alias("drop_approved_to_dispatched"),
        (s3 - s4).alias("drop_dispatched_to_delivered"),
        ratio_round(s2 * 100, s1, 1).alias("pct_approved"),
        ratio_round(s3 * 100, s1, 1).alias("pct_dispatched"),
        ratio_round(s4 * 100, s1, 1).alias("pct_delivered"),
        *stages.columns[4:],
        (tenths / F.lit(10.0)).alias("avg_total_fulfillment_hours"),
    )
