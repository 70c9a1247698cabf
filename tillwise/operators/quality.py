"""Profiles and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: name, row count, NULL count; a single pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    per_column = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_nulls"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select("n_rows", F.explode(per_column).alias("c")).select(
        "c.column", "n_rows", "c.n_nulls"
    )


def null_columns(profile: DataFrame) -> DataFrame:
    """The part of a profile that shows columns with NULLs."""
    return profile.filter(F.col("n_nulls") > 0)


def check_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when the constraint holds."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_foreign_key(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child keys without a parent row, with the number of child rows.

    Child rows are counted per key before the join, so a hot key is one row there.
    """
    counted = (
        child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    )
    return counted.join(parent.select(key), key, "left_anti")


def orphan_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """customer_ids of orders that customer de-duplication removed."""
    return check_foreign_key(orders, customers, "customer_id")


def single_purchase_rate(features: DataFrame) -> DataFrame:
    """Share of customers with exactly one order, in percent."""
    once = F.count_if(F.col("frequency") == 1)
    return features.agg((once * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("single_pct"))
