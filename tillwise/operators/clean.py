"""Cleaning operators: raw tables to the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import amount, cents, whole_days
from tillwise.operators.ranking import first_per_key
from tillwise.operators.skew import spread_join, vocabulary_join
from tillwise.params import DEFAULTS

# fixed values: columns read as timestamps, and product columns that are dropped
ORDER_DATES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]
DROPPED_PRODUCT_COLUMNS = [
    "product_name_lenght",
    "product_description_lenght",
    "product_photos_qty",
]


def clean_customers(customers: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """First row of each customer_unique_id in file order (``order_cols``)."""
    return first_per_key(customers, ["customer_unique_id"], order_cols or ["customer_id"])


def customer_id_map(customers: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """All customers, each with the customer_id that ``clean_customers`` keeps.

    Joining orders through ``kept_customer_id`` saves the orders that
    de-duplication orphans.
    """
    kept = clean_customers(customers, order_cols).select(
        "customer_unique_id", F.col("customer_id").alias("kept_customer_id")
    )
    return spread_join(customers, kept, "customer_unique_id", ["customer_id"])


def parse_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to timestamps without time zone; malformed text is an error, NULL stays NULL."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns if c in df.columns})


def filter_delivered(orders: DataFrame, status: str = DEFAULTS.delivered_status) -> DataFrame:
    return orders.filter(F.col("order_status") == status)


def delivery_delay_days(orders: DataFrame) -> DataFrame:
    """Adds delivery_delay_days: whole days after the estimate, NULL while undelivered."""
    late = whole_days(
        F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    )
    return orders.withColumn("delivery_delay_days", late)


def clean_orders(orders: DataFrame, status: str | None = DEFAULTS.delivered_status) -> DataFrame:
    """Parsed orders of one status (all when None) with their delivery delay."""
    parsed = parse_timestamps(orders, ORDER_DATES)
    return delivery_delay_days(filter_delivered(parsed, status) if status else parsed)


def item_total_value(items: DataFrame) -> DataFrame:
    total = (F.col("price") + F.col("freight_value")).cast("decimal(18,2)")
    return items.withColumn("total_value", total)


def clean_items(items: DataFrame) -> DataFrame:
    return item_total_value(parse_timestamps(items, ["shipping_limit_date"]))


def aggregate_payments(payments: DataFrame, seq_col: str = "payment_sequential") -> DataFrame:
    """One row per order: total, distinct types in first-seen order, largest instalment count.

    Grouping by (order, type) first keeps the per-order list as short as the
    list of payment types, whatever the number of payments of an order.
    """
    by_type = (
        payments.filter(F.col("order_id").isNotNull())
        .groupBy("order_id", "payment_type")
        .agg(
            F.sum(cents("payment_value")).alias("c"),
            F.min(seq_col).alias("seq"),
            F.max("payment_installments").alias("installments"),
        )
    )
    seen = F.array_sort(F.collect_list(F.struct("seq", "payment_type")))
    return by_type.groupBy("order_id").agg(
        amount(F.sum("c")).alias("total_payment"),
        F.array_join(F.transform(seen, lambda x: x["payment_type"]), ",").alias("payment_types"),
        F.max("installments").alias("installments"),
    )


def translate_category(products: DataFrame, category: DataFrame) -> DataFrame:
    """Products with their English category name, NULL where there is none."""
    return vocabulary_join(products, category, "product_category_name", ["product_id"])


def fill_unknown(
    products: DataFrame, column: str = "product_category_name_english"
) -> DataFrame:
    return products.fillna({column: "unknown"})


def clean_products(products: DataFrame, category: DataFrame) -> DataFrame:
    return fill_unknown(translate_category(products, category)).drop(*DROPPED_PRODUCT_COLUMNS)


def clean_sellers(sellers: DataFrame) -> DataFrame:
    return sellers


def clean_reviews(reviews: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """One (order_id, review_score) per order, the first by ``order_cols`` (``row_order``)."""
    order_cols = order_cols or ["row_order"]
    needed = list(dict.fromkeys(["order_id", "review_score", *order_cols]))
    kept = first_per_key(reviews.select(*needed), ["order_id"], order_cols)
    return kept.select("order_id", "review_score")


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without NULL in ``columns`` (all when None)."""
    return df.dropna(subset=columns)
