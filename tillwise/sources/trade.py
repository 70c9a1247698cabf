"""Raw retail tables derived from the order-trade test tables (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions import amount
from tillwise.sources.star import Star, build_star


def _days_hours(days: Column | int, hours: Column | int) -> Column:
    as_int = [F.lit(x) if isinstance(x, int) else x.cast("int") for x in (days, hours)]
    return F.make_dt_interval(*as_int)


def trade_star(raw: TradeTables) -> Star:
    """The star of the test tables: their ids say which of several rows came first."""
    return build_star(raw, customer_order=["customer_id"], review_order=["review_seq"])


class TradeTables(Mapping):
    """The raw tables (without geolocation), each a plan over the Parquet files built on first use."""

    names = (
        "customers",
        "orders",
        "order_items",
        "payments",
        "reviews",
        "products",
        "sellers",
        "category",
    )

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = getattr(self, f"_{name}")()
        return self._built[name]

    def __iter__(self):
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def _placed(self, df: DataFrame, nation_key: str) -> DataFrame:
        nation, region = self._read("nation"), self._read("region")
        return df.join(nation, F.col(nation_key) == F.col("n_nationkey")).join(
            region, F.col("n_regionkey") == F.col("r_regionkey")
        )

    def _customers(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._placed(self._read("customer"), "c_nationkey").select(
            key.alias("customer_id"),
            F.when(key % 5 == 4, key - 1).otherwise(key).alias("customer_unique_id"),
            F.col("n_name").alias("customer_city"),
            F.col("r_name").alias("customer_state"),
        )

    def _sellers(self) -> DataFrame:
        return self._placed(self._read("supplier"), "s_nationkey").select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("n_name").alias("seller_city"),
            F.col("r_name").alias("seller_state"),
        )

    def _orders(self) -> DataFrame:
        ok, ck, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
        bought = F.col("o_orderdate").cast("timestamp_ntz")
        shipped = bought + _days_hours(ck % 7, ok % 48)
        arrived = shipped + _days_hours((ok * 7 + ck) % 23, 0)
        skipped = (status == "P") & (ok % 2 == 0)
        return self._read("orders").select(
            ok.alias("order_id"),
            ck.alias("customer_id"),
            F.when(status == "F", "delivered")
            .when(status == "O", "shipped")
            .otherwise("processing")
            .alias("order_status"),
            bought.alias("order_purchase_timestamp"),
            F.when(~skipped, bought + _days_hours(0, ok % 48)).alias("order_approved_at"),
            F.when(status.isin("O", "F"), shipped).alias("order_delivered_carrier_date"),
            F.when(status == "F", arrived).alias("order_delivered_customer_date"),
            (bought + _days_hours(18, 0)).alias("order_estimated_delivery_date"),
        )

    def _reviews(self) -> DataFrame:
        """Not every order is reviewed: one without a stated priority has no review row.

        Orders of score 2 are reviewed three times, with 3, 2 and 1, and those of score 3 twice, with
        3 and 5: so neither the least nor the greatest score is always the first.
        """
        priority = F.col("o_orderpriority")
        score = F.col("review_score")
        once = (
            self._read("orders")
            .filter(priority != "4-NOT SPECIFIED")
            .select(
                F.col("o_orderkey").alias("order_id"),
                F.when(priority != "5-LOW", F.substring(priority, 1, 1))
                .when(F.col("o_totalprice") < 250000, "4")
                .otherwise("5")
                .cast("int")
                .alias("review_score"),
            )
        )
        given = (
            F.when(score == 2, F.array(F.lit(3), F.lit(2), F.lit(1)))
            .when(score == 3, F.array(F.lit(3), F.lit(5)))
            .otherwise(F.array(score))
        )
        return once.select("order_id", F.posexplode(given).alias("review_seq", "review_score"))

    def _lines(self) -> DataFrame:
        """Order lines with price and freight in cents."""
        price = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
        percent = F.rint(F.col("l_tax") * 100).cast("bigint")
        return self._read("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").cast("timestamp_ntz").alias("shipping_limit_date"),
            F.col("l_linenumber").alias("payment_sequential"),
            F.col("l_returnflag").alias("payment_type"),
            price.alias("p"),
            F.call_function("div", price * percent, F.lit(100)).alias("f"),
        )

    def _order_items(self) -> DataFrame:
        return self._lines().select(
            "order_id",
            "product_id",
            "seller_id",
            "shipping_limit_date",
            amount(F.col("p")).alias("price"),
            amount(F.col("f")).alias("freight_value"),
        )

    def _payments(self) -> DataFrame:
        return self._lines().select(
            "order_id",
            "payment_sequential",
            "payment_type",
            (F.col("payment_sequential") + 1).alias("payment_installments"),
            amount(F.col("p") + F.col("f")).alias("payment_value"),
        )

    def _products(self) -> DataFrame:
        kind = F.lower("p_type")
        return self._read("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(kind != "promo", kind).alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.length("p_brand").alias("product_description_lenght"),
            F.col("p_size").alias("product_photos_qty"),
        )

    def _category(self) -> DataFrame:
        name = F.col("product_category_name")
        names = self._read("part").select(F.lower("p_type").alias("product_category_name"))
        return names.filter(name != "small").distinct().withColumn(
            "product_category_name_english", F.concat(F.lit("en_"), name)
        )
