"""Frames at order grain that several operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import cents


def paid_orders(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per paid order: customer, purchase time, total in cents, instalments."""
    paid = payments.select("order_id", cents("total_payment").alias("pay"), "installments")
    bought = orders.select("order_id", "customer_id", "order_purchase_timestamp")
    return bought.join(paid, "order_id")


def customer_orders(customers: DataFrame, orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Per customer_unique_id: number of paid orders, cents spent, last purchase.

    Orders are reduced per customer_id before the customer table is joined, so a
    customer with very many orders is one row there, and the join uses the
    partitioning of that aggregate.  Paid orders are unique per order_id, so
    counting rows is counting distinct orders.
    """
    totals = [
        F.sum("n_orders").alias("n_orders"),
        F.sum("pay").alias("pay"),
        F.max("last_purchase").alias("last_purchase"),
    ]
    per_id = (
        paid_orders(orders, payments)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum("pay").alias("pay"),
            F.max("order_purchase_timestamp").alias("last_purchase"),
        )
    )
    return (
        customers.select("customer_id", "customer_unique_id")
        .join(per_id, "customer_id")
        .groupBy("customer_unique_id")
        .agg(*totals)
    )
