"""Churn features and what is computed from them in plain SQL terms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import as_date, cents, money, month_start, ratio_round
from tillwise.functions.numeric import ratio_units
from tillwise.operators.grain import paid_orders
from tillwise.operators.ranking import keys_at_ranks
from tillwise.operators.skew import spread_join
from tillwise.params import DEFAULTS
from tillwise.sources.star import Star

# fixed values: model inputs; recency_days is left out because it defines the label
FEATURES = [
    "frequency",
    "monetary",
    "avg_order_value",
    "avg_review_score",
    "active_months",
    "avg_installments",
    "avg_freight_ratio",
    "unique_products",
    "gave_review",
    "max_order_value",
    "min_order_value",
]
LABEL = "churned"

NANO = 1_000_000_000


def reference_date(orders: DataFrame) -> DataFrame:
    """Date of the last purchase, one row; ``.scalar()`` makes it a column."""
    return orders.agg(F.max("order_purchase_timestamp").cast("date").alias("ref_date"))


def churn_features(
    star: Star, ref_date: Column | dt.date | str, dedupe_orders: bool = False
) -> DataFrame:
    """One row per customer with orders that have items and payment.

    Order figures weigh by the items of the order, as in the joined tables;
    ``dedupe_orders`` gives each order the weight 1.

    Orders get their customer first (narrow rows, hot customers spread).  All
    figures but one come from order grain, rolled up by (customer, month) so
    that active months are a row count.  Distinct products take their own
    branch at (customer, product) grain.  Freight ratios are summed in whole
    billionths, so that the order of addition does not matter.
    """
    owned = spread_join(
        star.orders.select("order_id", "customer_id", "order_purchase_timestamp"),
        star.customers.select("customer_id", "customer_unique_id"),
        "customer_id",
        ["order_id"],
    )
    placed = owned.select(
        "order_id", F.col("customer_unique_id").alias("customer_id"), "order_purchase_timestamp"
    )
    price = cents("price")
    ratio = F.call_function("div", cents("freight_value") * NANO, F.nullif(price, F.lit(0)))
    per_order = star.items.groupBy("order_id").agg(
        (F.lit(1) if dedupe_orders else F.count(F.lit(1))).cast("bigint").alias("n"),
        F.sum(ratio).alias("ratio"),
        F.count(ratio).alias("ratio_n"),
    )
    n, pay, score, inst = (F.col(c) for c in ("n", "pay", "review_score", "installments"))
    orders = (
        paid_orders(placed, star.payments)
        .join(per_order, "order_id")
        .join(star.reviews, "order_id", "left")
        .select(
            F.col("customer_id").alias("customer_unique_id"),
            month_start("order_purchase_timestamp").alias("month"),
            F.col("order_purchase_timestamp").alias("last"),
            F.lit(1).cast("bigint").alias("orders"),
            n,
            (pay * n).alias("spent"),
            pay.alias("hi"),
            pay.alias("lo"),
            (inst * n).alias("inst"),
            F.when(inst.isNotNull(), n).alias("inst_n"),
            (score * n).alias("score"),
            F.when(score.isNotNull(), n).alias("score_n"),
            "ratio",
            "ratio_n",
        )
    )
    sums = ["orders", "n", "spent", "inst", "inst_n", "score", "score_n", "ratio", "ratio_n"]
    rolled = [
        *[F.sum(c).alias(c) for c in sums],
        F.max("last").alias("last"),
        F.max("hi").alias("hi"),
        F.min("lo").alias("lo"),
    ]
    figures = (
        orders.groupBy("customer_unique_id", "month")
        .agg(*rolled)
        .groupBy("customer_unique_id")
        .agg(*rolled, F.count("month").alias("active_months"))
    )
    # Orders without payment do not count, so the product branch joins them too.
    bought = paid_orders(placed, star.payments.select("order_id", "total_payment", "installments"))
    products = (
        star.items.select("order_id", "product_id")
        .distinct()
        .join(bought.select("order_id", F.col("customer_id").alias("customer_unique_id")), "order_id")
        .groupBy("customer_unique_id", "product_id")
        .agg(F.lit(1))
        .groupBy("customer_unique_id")
        .agg(F.count("product_id").alias("unique_products"))
    )
    last = F.col("last").cast("date")
    return figures.join(products, "customer_unique_id").select(
        "customer_unique_id",
        F.col("orders").alias("frequency"),
        money("spent").alias("monetary"),
        F.datediff(as_date(ref_date), last).alias("recency_days"),
        money(ratio_round(F.col("spent"), n)).alias("avg_order_value"),
        ratio_round(F.col("score"), F.col("score_n"), 2).alias("avg_review_score"),
        "active_months",
        ratio_round(F.col("inst"), F.col("inst_n"), 2).alias("avg_installments"),
        ratio_round(F.col("ratio"), F.col("ratio_n").cast("decimal(19,0)") * NANO, 4).alias(
            "avg_freight_ratio"
        ),
        "unique_products",
        F.when(F.col("score_n") > 0, 1).otherwise(0).alias("gave_review"),
        money("hi").alias("max_order_value"),
        money("lo").alias("min_order_value"),
    )


def churn_label(features: DataFrame, threshold: int = DEFAULTS.churn_high_days) -> DataFrame:
    late = F.col("recency_days") > threshold
    return features.withColumn(LABEL, F.when(late, 1).otherwise(0))


def churn_breakdown(labelled: DataFrame) -> DataFrame:
    """Customers per label and their share in percent."""
    total = F.count(F.lit(1))
    both = labelled.agg(
        F.count_if(F.col(LABEL) == 0).alias("0"), F.count_if(F.col(LABEL) == 1).alias("1"),
        total.alias("n"),
    )
    rows = F.array(
        *[F.struct(F.lit(x).alias(LABEL), F.col(str(x)).alias("customers")) for x in (0, 1)]
    )
    return both.select("n", F.explode(rows).alias("r")).select(
        f"r.{LABEL}", "r.customers", ratio_round(F.col("r.customers") * 100, F.col("n"), 1).alias("pct")
    )


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str = LABEL,
    test: float = DEFAULTS.test_size,
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Adds is_test: exactly round(test * n) rows of each class.

    Rows are put in the order of a hash of id and seed, and the first ones of
    each class are test rows.  The last of them is found as an order statistic,
    so no class passes through one task.  ``df`` is read three times.
    """
    spot = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))
    wanted = int(round(test * 1000))
    classes = [0, 1]
    keyed = df.filter(F.col(label).isin(classes)).select(
        F.struct(
            F.col(label).cast("int").alias("w"),
            F.lit(False).alias("f"),
            F.lit(0).alias("v"),
            spot.alias("i"),
        ).alias("k")
    )

    def last_test_row(_, n):
        return [r for r in [(2 * n * wanted + 1000) // 2000] if r > 0]

    found = keys_at_ranks(keyed, last_test_row)
    is_test = F.lit(False)
    for w, keys in found.items():
        for key in keys.values():
            is_test |= (F.col(label) == w) & (spot <= F.lit(key["i"]))
    return df.withColumn("is_test", is_test)


def business_impact(
    labelled: DataFrame,
    rate_pct: int = DEFAULTS.winback_rate_pct,
    high_rate_pct: int = DEFAULTS.winback_high_rate_pct,
    high_value: int = DEFAULTS.high_value_spend,
    high_value_rate_pct: int = DEFAULTS.high_value_rate_pct,
) -> DataFrame:
    """Churned customers, their spend, and recoverable revenue at several rates."""
    churned = F.col(LABEL) == 1
    rich = churned & (F.col("monetary") > high_value)
    spent = cents("monetary")
    base = labelled.agg(
        F.count_if(churned).alias("total_at_risk"),
        F.count_if(rich).alias("hv_n"),
        F.sum(F.when(churned, spent)).alias("s"),
        F.sum(F.when(rich, spent)).alias("h"),
    )
    return base.select(
        "total_at_risk",
        money(ratio_round(F.col("s"), F.col("total_at_risk"))).alias("avg_spend"),
        money(ratio_units(F.col("s").cast("decimal(20,0)") * rate_pct, 100)).alias("recoverable_15"),
        money(ratio_units(F.col("s").cast("decimal(20,0)") * high_rate_pct, 100)).alias(
            "recoverable_25"
        ),
        "hv_n",
        money(ratio_units(F.col("h").cast("decimal(20,0)") * high_value_rate_pct, 100)).alias(
            "hv_recoverable"
        ),
    )


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in long form, one pass.

    Only covariances are aggregated; NULL where a column is constant.
    """
    at = range(len(cols))
    x = [F.col(c).cast("double") for c in cols]
    covs = df.agg(
        *[F.covar_pop(x[i], x[j]).alias(f"{i}_{j}") for i in at for j in at if i <= j]
    )

    def corr(i: int, j: int) -> Column:
        spread = F.sqrt(f"{i}_{i}") * F.sqrt(f"{j}_{j}")
        return F.col(f"{min(i, j)}_{max(i, j)}") / F.nullif(spread, F.lit(0.0))

    cells = [
        F.struct(F.lit(cols[i]).alias("x"), F.lit(cols[j]).alias("y"), corr(i, j).alias("corr"))
        for i in at
        for j in at
    ]
    return covs.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def label_correlation(matrix: DataFrame, label: str = LABEL) -> DataFrame:
    """Correlation of each feature with the label, sorted."""
    return (
        matrix.filter((F.col("x") == label) & (F.col("y") != label))
        .select(F.col("y").alias("feature"), "corr")
        .orderBy(F.col("corr").asc_nulls_last(), "feature")
    )


def clipped_histogram(
    df: DataFrame, col: str, upper: float, bins: int = 50, by: list[str] | None = None
) -> DataFrame:
    """Counts in ``bins`` equal bins between the least and largest clipped value.

    With ``by`` (columns of few values, such as the label) each group has its own
    range; the ranges travel as one small map, so no rows are moved for them.
    Empty bins have no row.  ``df`` is read twice.
    """
    by = by or []
    clipped = df.filter(F.col(col).isNotNull()).select(
        *by, F.least(F.col(col).cast("double"), F.lit(float(upper))).alias("v")
    )
    group = F.struct(*by) if by else F.struct(F.lit(1))
    spans = clipped.groupBy(group.alias("g")).agg(
        F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("e")
    )
    ranges = spans.agg(F.map_from_entries(F.collect_list(F.struct("g", "e")))).scalar()
    ranged = clipped.withColumn("e", F.element_at(ranges, group)).select(*by, "v", "e.lo", "e.hi")
    lo, hi = F.col("lo"), F.col("hi")
    # a range of one value is widened by half a unit on both sides
    lo2 = F.when(lo == hi, lo - 0.5).otherwise(lo)
    hi2 = F.when(lo == hi, hi + 0.5).otherwise(hi)
    at = F.floor((F.col("v") - lo2) / (hi2 - lo2) * bins)
    return ranged.groupBy(*by, F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )


def eda_stats(labelled: DataFrame) -> DataFrame:
    """Class counts, churn rate, average spend by class, average freight ratio."""
    n, spent = F.count(F.lit(1)), cents("monetary")
    churned, active = F.col(LABEL) == 1, F.col(LABEL) == 0
    tenths = F.rint(F.col("avg_freight_ratio") * 10000).cast("bigint")
    return labelled.agg(
        n.alias("customers"),
        F.count_if(active).alias("active"),
        F.count_if(churned).alias("churned"),
        ratio_round(F.count_if(churned) * 100, n, 1).alias("churn_rate_pct"),
        money(ratio_round(F.sum(F.when(active, spent)), F.count_if(active))).alias("avg_spend_active"),
        money(ratio_round(F.sum(F.when(churned, spent)), F.count_if(churned))).alias(
            "avg_spend_churned"
        ),
        (ratio_round(F.sum(tenths), F.count(tenths)) / F.lit(10000.0)).alias("avg_freight_ratio"),
    )
