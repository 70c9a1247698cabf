"""The five KPI views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions import as_date, money, month_start, ratio_round
from tillwise.operators.grain import customer_orders, paid_orders
from tillwise.operators.rfm import rfm_base, rfm_scored, rfm_segments, score_boundaries
from tillwise.operators.skew import measured_salts, spread_join
from tillwise.params import DEFAULTS
from tillwise.sources.star import TABLES, Star


def v_monthly_revenue(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Per month: orders, customers, revenue, average order value.

    Rows are first reduced to (month, customer), which makes the distinct count
    a plain count and leaves no month to a single task.
    """
    per_customer = (
        paid_orders(orders, payments)
        .groupBy(month_start("order_purchase_timestamp").alias("month"), "customer_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("pay").alias("pay"))
    )
    return per_customer.groupBy("month").agg(
        F.sum("n").alias("total_orders"),
        F.count("customer_id").alias("unique_customers"),
        money(F.sum("pay")).alias("revenue"),
        money(ratio_round(F.sum("pay"), F.sum("n"))).alias("avg_order_value"),
    )


def churn_risk_label(
    days: Column, high: int = DEFAULTS.churn_high_days, medium: int = DEFAULTS.churn_medium_days
) -> Column:
    return (
        F.when(days > high, "High Risk").when(days > medium, "Medium Risk").otherwise("Low Risk")
    )


def v_churn_risk(
    customers: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    as_of: Column | dt.date | str,
    high: int = DEFAULTS.churn_high_days,
    medium: int = DEFAULTS.churn_medium_days,
) -> DataFrame:
    """Per customer: orders, spend, last order, days since then, risk label."""
    last = F.col("last_purchase").cast("date")
    return (
        customer_orders(customers, orders, payments)
        .select(
            "customer_unique_id",
            F.col("n_orders").alias("total_orders"),
            money("pay").alias("total_spent"),
            last.alias("last_order_date"),
            F.datediff(as_date(as_of), last).alias("days_since_last_order"),
        )
        .withColumn("churn_risk_label", churn_risk_label(F.col("days_since_last_order"), high, medium))
    )


def v_rfm_segments(
    customers: DataFrame,
    orders: DataFrame,
    payments: DataFrame,
    as_of: Column | dt.date | str,
    boundaries: DataFrame | None = None,
) -> DataFrame:
    """Per customer: recency, frequency, monetary, their scores and the segment."""
    base = rfm_base(customers, orders, payments, as_of)
    return rfm_segments(rfm_scored(base, boundaries=boundaries)).drop("rfm_avg")


def product_salts(star: Star) -> DataFrame:
    """How widely the items of hot products are spread when products are joined."""
    return measured_salts(star.items, "product_id")


def v_category_performance(
    star: Star, dedupe_orders: bool = False, salts: DataFrame | None = None
) -> DataFrame:
    """Per category: orders, revenue, average order value, average review score.

    A payment counts once per item of its order, as in the joined tables; with
    ``dedupe_orders`` it counts once per order and category.

    Items are reduced to (order, product) first, products are joined with hot
    ones spread by order, and the rest is one row per (order, category).  ``salts``
    are those of ``product_salts``, measured now if not given.
    """
    salts = product_salts(star) if salts is None else salts
    pairs = star.items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    products = star.products.select("product_id", "product_category_name_english")
    in_category = (
        spread_join(pairs, products, "product_id", ["order_id"], salts=salts)
        .groupBy("order_id", "product_category_name_english")
        .agg((F.lit(1) if dedupe_orders else F.sum("n")).cast("bigint").alias("n"))
    )
    n, score = F.col("n"), F.col("review_score")
    per_category = (
        in_category.join(paid_orders(star.orders, star.payments).select("order_id", "pay"), "order_id")
        .join(star.reviews, "order_id", "left")
        .groupBy("product_category_name_english")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum(F.col("pay") * n).alias("c"),
            F.sum(n).alias("n"),
            F.sum(score * n).alias("s"),
            F.sum(F.when(score.isNotNull(), n)).alias("sn"),
        )
    )
    return per_category.select(
        F.coalesce("product_category_name_english", F.lit("unknown")).alias("category"),
        "total_orders",
        money("c").alias("total_revenue"),
        money(ratio_round(F.col("c"), n)).alias("avg_order_value"),
        ratio_round(F.col("s"), F.col("sn"), 2).alias("avg_review_score"),
    )


def late_risk(
    late_pct: Column, high: float = DEFAULTS.late_high_pct, medium: float = DEFAULTS.late_medium_pct
) -> Column:
    """Risk label of a (rounded) share of late deliveries."""
    return F.when(late_pct >= high, "High Risk").when(late_pct >= medium, "Medium Risk").otherwise("Good")


def seller_totals(star: Star, min_orders: int = DEFAULTS.min_seller_orders) -> DataFrame:
    """Per seller with at least ``min_orders`` orders: delay, late items, review score.

    Late deliveries count item rows, the base of late_pct counts orders, so
    late_pct may pass 100.  Sellers are joined after the aggregate, one row each.
    """
    n, delay, score = F.col("n"), F.col("delivery_delay_days"), F.col("review_score")
    per_seller = (
        star.items.groupBy("order_id", "seller_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(star.orders.select("order_id", "delivery_delay_days"), "order_id")
        .join(star.reviews, "order_id", "left")
        .groupBy("seller_id")
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum(delay * n).alias("d"),
            F.sum(F.when(delay.isNotNull(), n)).alias("dn"),
            F.sum(score * n).alias("s"),
            F.sum(F.when(score.isNotNull(), n)).alias("sn"),
            F.sum(F.when(delay > 0, n).otherwise(0)).alias("late_deliveries"),
        )
        .filter(F.col("total_orders") >= min_orders)
    )
    return star.sellers.join(per_seller, "seller_id").select(
        "seller_id",
        "seller_city",
        "seller_state",
        "total_orders",
        ratio_round(F.col("d"), F.col("dn"), 1).alias("avg_delay_days"),
        "late_deliveries",
        ratio_round(F.col("late_deliveries") * 100, F.col("total_orders"), 1).alias("late_pct"),
        ratio_round(F.col("s"), F.col("sn"), 2).alias("avg_review_score"),
    )


def v_seller_risk(
    star: Star,
    min_orders: int = DEFAULTS.min_seller_orders,
    high: float = DEFAULTS.late_high_pct,
    medium: float = DEFAULTS.late_medium_pct,
) -> DataFrame:
    """Sellers with their delays, review score, late share and risk rating."""
    return seller_totals(star, min_orders).select(
        "seller_id",
        "seller_city",
        "seller_state",
        "total_orders",
        "avg_delay_days",
        "avg_review_score",
        "late_pct",
        late_risk(F.col("late_pct"), high, medium).alias("risk_rating"),
    )


def _newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of a table that ``refresh_views`` appends to; reading it runs no job."""
    table = spark.read.schema(f"version bigint, {schema}").parquet(path)
    newest = table.agg(F.max("version")).scalar()
    return table.filter(F.col("version") == newest).drop("version")


def _stored(spark: SparkSession, star: Star, folder: str) -> tuple[DataFrame, DataFrame]:
    """Band boundaries and product salts."""
    customer = star.customers.schema["customer_unique_id"].dataType.simpleString()
    product = star.items.schema["product_id"].dataType.simpleString()
    return (
        _newest(spark, f"{folder}/bands", f"name string, f boolean, v bigint, i {customer}"),
        _newest(spark, f"{folder}/salts", f"product_id {product}, n_salts int"),
    )


def register_views(
    spark: SparkSession, star: Star, as_of: Column | dt.date | str, boundaries: str | None = None
) -> list[str]:
    """The five views as temp views, next to the star tables; returns all names.

    With ``boundaries``, the folder that ``refresh_views`` keeps, registering runs no job:
    v_rfm_segments bands its rows, whatever they are when it is asked, by the stored boundaries, and
    v_category_performance spreads hot products as they were measured.  Without, both are found now and
    the boundaries stay those of the present rows.
    """
    c, o, p = star.customers, star.orders, star.payments
    bounds, salts = _stored(spark, star, boundaries) if boundaries else (None, None)
    frames = {TABLES[name]: getattr(star, name) for name in TABLES} | {
        "v_monthly_revenue": v_monthly_revenue(o, p),
        "v_churn_risk": v_churn_risk(c, o, p, as_of),
        "v_rfm_segments": v_rfm_segments(c, o, p, as_of, bounds),
        "v_category_performance": v_category_performance(star, salts=salts),
        "v_seller_risk": v_seller_risk(star),
    }
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return list(frames)


def refresh_views(
    spark: SparkSession, star: Star, as_of: Column | dt.date | str, boundaries: str
) -> list[str]:
    """Stores new band boundaries and product salts of ``star`` and registers the views over them.

    Versions are appended, so readers of the one before are not disturbed; ``star`` is the star as it
    is now, loaded again if its tables grew.
    """
    found = score_boundaries(rfm_base(star.customers, star.orders, star.payments, as_of))
    version = F.unix_micros(F.current_timestamp()).alias("version")
    for name, table in (("bands", found), ("salts", product_salts(star))):
        table.coalesce(1).select(version, "*").write.mode("append").parquet(f"{boundaries}/{name}")
    return register_views(spark, star, as_of, boundaries)
