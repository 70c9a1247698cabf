"""Dashboard figures and the facts and lines of the written report.

Inputs are the KPI views, so everything after the first aggregate here is a few
rows: months, segments, labels, categories.
"""

from __future__ import annotations

import datetime as dt
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.functions import cents, money, ratio_round
from tillwise.functions.numeric import ratio_units
from tillwise.operators.ranking import top_k
from tillwise.params import DEFAULTS
from tillwise.session import materialize

# fixed values: recommended actions
SEGMENT_ACTIONS = {
    "Champions": "🏆 VIP loyalty programme + early access",
    "Loyal Customers": "🔄 Subscription model + referral incentives",
    "Potential Loyalists": "📈 Personalised recommendations + discounts",
    "New Customers": "👋 Onboarding campaign + first purchase offer",
    "At Risk": "⚠️ Win-back campaign + personalised discount",
    "Need Attention": "📧 Low-cost email reactivation",
}
CLUSTER_ACTIONS = {
    "High Value Active": "VIP loyalty programme + early access offers",
    "Loyal Regulars": "Subscription model + referral incentives",
    "Lapsed High Value": "Win-back campaign + personalised discount",
    "Churned Low Value": "Low-cost email reactivation only",
    "Occasional Buyers": "Category-based push notifications",
}
DEFAULT_ACTION = "Monitor and analyse further"


def _one_row(**frames: DataFrame) -> DataFrame:
    """One-row frames side by side, each as a struct, read as scalar subqueries."""
    spark = next(iter(frames.values())).sparkSession
    return spark.range(1).select(
        *[f.select(F.struct("*")).scalar().alias(name) for name, f in frames.items()]
    )


# ---------------------------------------------------------------- dashboard


def kpi_summary(monthly: DataFrame, churn: DataFrame, customers: DataFrame) -> DataFrame:
    """Total revenue, orders, customers and high-risk customers.

    ``customers`` is any frame with one row per scored customer (the RFM view or
    its base); only its rows are counted.
    """
    return _one_row(
        m=monthly.agg(
            money(F.sum(cents("revenue"))).alias("total_revenue"),
            F.sum("total_orders").alias("total_orders"),
        ),
        c=customers.agg(F.count(F.lit(1)).alias("total_customers")),
        r=churn.agg(
            F.count_if(F.col("churn_risk_label") == "High Risk").alias("at_risk_customers")
        ),
    ).select("m.total_revenue", "m.total_orders", "c.total_customers", "r.at_risk_customers")


def segment_overview(segments: DataFrame) -> DataFrame:
    """Customers, average and total spend per segment."""
    spent, n = F.sum(cents("monetary")), F.count(F.lit(1))
    return (
        segments.groupBy("segment")
        .agg(
            n.alias("customer_count"),
            money(ratio_round(spent, n)).alias("avg_monetary"),
            money(spent).alias("total_revenue"),
        )
        .orderBy(F.col("total_revenue").desc_nulls_first(), "segment")
    )


def churn_overview(churn: DataFrame) -> DataFrame:
    """Customers and average spend per risk label."""
    spent, n = F.sum(cents("total_spent")), F.count(F.lit(1))
    return (
        churn.groupBy("churn_risk_label")
        .agg(n.alias("customer_count"), money(ratio_round(spent, n)).alias("avg_spent"))
        .orderBy(F.col("customer_count").desc(), "churn_risk_label")
    )


def top_n_categories(categories: DataFrame, n: int = 10) -> DataFrame:
    return top_k(categories, "total_revenue", n, ["category"])


def worst_sellers(sellers: DataFrame, n: int = DEFAULTS.top_sellers) -> DataFrame:
    return top_k(sellers, "late_pct", n, ["seller_id"])


def seller_risk_counts(sellers: DataFrame) -> DataFrame:
    """Sellers per rating, over all or over the result of ``worst_sellers``."""
    return sellers.groupBy("risk_rating").agg(F.count(F.lit(1)).alias("count"))


def customer_sample(segments: DataFrame, n: int = 5000) -> DataFrame:
    return segments.orderBy("customer_unique_id").limit(n)


def mom_growth(monthly: DataFrame) -> DataFrame:
    """Monthly view with growth in percent of the month before, NULL on a zero base."""
    before = F.lag("revenue").over(W.orderBy("month"))  # one row per month
    growth = (F.col("revenue") / F.nullif(before, F.lit(0.0)) - 1) * 100
    return monthly.withColumn("mom_growth", growth)


def revenue_cards(monthly: DataFrame) -> DataFrame:
    """Total, monthly average and peak month of revenue."""
    c, n = F.sum(cents("revenue")), F.count(F.lit(1))
    return monthly.agg(
        money(c).alias("total_revenue"),
        money(ratio_round(c, n)).alias("avg_monthly_revenue"),
        _best("month").alias("peak_month"),
    )


def with_action(df: DataFrame, label: str, actions: dict[str, str]) -> DataFrame:
    """Adds the recommended action of a label, the default one for other labels."""
    pairs = F.create_map(*[F.lit(x) for pair in actions.items() for x in pair])
    found = F.element_at(pairs, F.col(label))
    return df.withColumn("action", F.coalesce(found, F.lit(DEFAULT_ACTION)))


def segment_actions(segments: DataFrame) -> DataFrame:
    return with_action(segments, "segment", SEGMENT_ACTIONS)


def cluster_actions(profile: DataFrame) -> DataFrame:
    return with_action(profile, "label", CLUSTER_ACTIONS)


# ---------------------------------------------------------------- report facts


def _best(value: str) -> Column:
    """``value`` of the month with most revenue, the first one of equals."""
    return F.min_by(value, F.struct(-F.col("revenue"), F.col("month")))


def _worst(value: str) -> Column:
    return F.min_by(value, F.struct(F.col("revenue"), F.col("month")))


def revenue_facts(monthly: DataFrame) -> DataFrame:
    """Total, mean, number of months, best and worst month, ups and downs, mean growth."""
    c, n, growth = F.sum(cents("revenue")), F.count(F.lit(1)), F.col("mom_growth")
    return mom_growth(monthly).agg(
        money(c).alias("total_rev"),
        money(ratio_round(c, n)).alias("avg_rev"),
        n.alias("n_months"),
        _best("month").alias("max_month"),
        F.max("revenue").alias("max_rev"),
        _worst("month").alias("min_month"),
        F.min("revenue").alias("min_rev"),
        F.count_if(growth > 0).alias("positive_months"),
        F.count_if(growth < 0).alias("negative_months"),
        F.avg(growth).alias("avg_growth"),
    )


def revenue_anomalies(monthly: DataFrame, z: float = DEFAULTS.anomaly_z) -> DataFrame:
    """Months further than ``z`` sample standard deviations from the mean."""
    everything = W.partitionBy(F.lit(1))  # one row per month
    c = cents("revenue")
    stats = monthly.select(
        "month",
        "revenue",
        c.alias("c"),
        F.avg("revenue").over(everything).alias("mean"),
        F.stddev_samp("revenue").over(everything).alias("std"),
        F.sum(c).over(everything).alias("total"),
        F.count(F.lit(1)).over(everything).alias("n"),
    )
    far = F.abs(F.col("revenue") - F.col("mean")) > F.lit(z) * F.col("std")
    # |c - total/n| / (total/n) in percent, in whole cents
    gap = F.abs(F.col("n") * F.col("c").cast("decimal(20,0)") - F.col("total"))
    return stats.filter(far).select(
        "month",
        "revenue",
        F.when(F.col("revenue") > F.col("mean"), "spike").otherwise("drop").alias("direction"),
        ratio_round(gap * 100, F.abs("total"), 1).alias("pct_diff"),
    )


def segment_facts(overview: DataFrame) -> DataFrame:
    """Customers, number of segments, largest segment with share, best average spend."""
    n = F.col("customer_count")
    by_size = F.struct(-n, F.col("segment"))
    by_spend = F.struct(-F.col("avg_monetary"), F.col("segment"))
    return overview.agg(
        F.sum(n).alias("total_customers"),
        F.count(F.lit(1)).alias("n_segments"),
        F.min_by("segment", by_size).alias("largest_segment"),
        F.max(n).alias("largest_count"),
        ratio_round(F.max(n) * 100, F.sum(n), 1).alias("largest_share_pct"),
        F.min_by("segment", by_spend).alias("best_segment"),
        F.max("avg_monetary").alias("best_avg_monetary"),
    )


def winback_value(
    overview: DataFrame, rate_pct: int = DEFAULTS.winback_rate_pct
) -> DataFrame:
    """High-risk customers, their rounded average spend, and what a win-back could recover."""
    high = overview.filter(F.col("churn_risk_label") == "High Risk")
    value = ratio_units(F.col("customer_count") * cents("avg_spent") * rate_pct, 100)
    return high.select(
        F.col("customer_count").alias("high_risk_customers"),
        F.col("avg_spent").alias("avg_spend"),
        money(value).alias("recoverable_revenue"),
    )


def category_facts(categories: DataFrame, n: int = 5) -> DataFrame:
    """First and last of the ``n`` best categories by revenue."""
    best = F.struct(F.col("total_revenue").isNotNull(), -F.col("total_revenue"), F.col("category"))
    row = F.struct("category", "total_revenue", "total_orders", "avg_review_score")
    ends = top_n_categories(categories, n).agg(
        F.min_by(row, best).alias("t"), F.max_by(row, best).alias("b")
    )
    return ends.select(
        F.col("t.category").alias("top_category"),
        F.col("t.total_revenue").alias("top_revenue"),
        F.col("t.total_orders").alias("top_orders"),
        F.col("t.avg_review_score").alias("top_review_score"),
        F.col("b.category").alias("bottom_category"),
        F.col("b.avg_review_score").alias("bottom_review_score"),
    )


def seller_facts(sellers: DataFrame) -> DataFrame:
    return sellers.agg(
        F.count_if(F.col("risk_rating") == "High Risk").alias("high_risk_sellers"),
        F.count_if(F.col("risk_rating") == "Medium Risk").alias("medium_risk_sellers"),
    )


# ---------------------------------------------------------------- report text

# fixed values: the wording of the report; {fact:kind} is filled from the facts
REPORT = {
    "REVENUE PERFORMANCE": [
        "The platform generated {r.total_rev:money} in total revenue across {r.n_months} months, "
        "averaging {r.avg_rev:money} per month.",
        "Revenue grew in {r.positive_months} months and declined in {r.negative_months} months, "
        "with an average month-over-month growth rate of {r.avg_growth:tenth}%.",
        "Peak revenue was recorded in {r.max_month:month} at {r.max_rev:money}, while the lowest "
        "month was {r.min_month:month} at {r.min_rev:money}.",
    ],
    "ANOMALY DETECTION": [],
    "CUSTOMER SEGMENTATION": [
        "RFM analysis segmented {s.total_customers:count} customers into {s.n_segments} distinct "
        "groups.",
        "The largest segment is '{s.largest_segment}' with {s.largest_count:count} customers "
        "({s.largest_share_pct:tenth}% of base).",
        "The highest-value segment is '{s.best_segment}' with avg spend of "
        "{s.best_avg_monetary:money} per customer.",
    ],
    "CHURN RISK ANALYSIS": [
        "{w.high_risk_customers:count} customers are classified as High Risk (inactive 180+ days), "
        "with an average historical spend of {w.avg_spend:money}.",
        "A targeted win-back campaign achieving a conservative 15% reactivation rate could recover "
        "{w.recoverable_revenue:money} in revenue.",
    ],
    "CATEGORY PERFORMANCE": [
        "The top revenue category is '{c.top_category}' generating {c.top_revenue:money} across "
        "{c.top_orders:count} orders with an avg review score of {c.top_review_score}.",
        "Among the top 5 categories, '{c.bottom_category}' has the lowest review score "
        "({c.bottom_review_score}) — a quality improvement opportunity worth investigating.",
    ],
    "SELLER RISK": [
        "Seller risk analysis identified {v.high_risk_sellers} high-risk sellers and "
        "{v.medium_risk_sellers} medium-risk sellers among those with 50+ orders.",
        "The {nullif(v.medium_risk_sellers, 0)} medium-risk sellers show 25-50% late delivery "
        "rates with direct correlation to below-average review scores. Immediate operational "
        "review recommended.",
    ],
    "STRATEGIC RECOMMENDATIONS": [
        "1. Launch win-back campaign targeting High Risk segment — "
        "{coalesce(w.recoverable_revenue, 0D):money} recoverable revenue opportunity.",
        "2. Invest in '{c.top_category}' category expansion — highest revenue with growth "
        "potential.",
        "3. Review medium-risk seller contracts — late deliveries directly reduce review scores "
        "and repeat purchase rates.",
        "4. Build loyalty programme for top RFM segments — protect the highest-value customer "
        "base.",
    ],
}
ANOMALY = (
    "ANOMALY DETECTED: {x.month:month} shows a revenue {x.direction} of {x.pct_diff:tenth}% from "
    "the monthly average ({x.revenue:money} vs avg {r.avg_rev:money}). Investigate for external "
    "factors or data issues."
)
NO_ANOMALY = "No significant revenue anomalies detected."


def _line(template: str, currency: str) -> str:
    """A template as a SQL expression; NULL when one of its facts is NULL."""
    kinds = {
        "": "cast({0} AS string)",
        "money": "concat(" + _quoted(currency) + ", format_number({0}, 2))",
        "count": "format_number({0}, 0)",
        "tenth": "format_string('%.1f', {0})",
        "month": "date_format({0}, 'MMMM yyyy')",
    }
    parts = []
    for text, fact, kind, _ in Formatter().parse(template):
        if text:
            parts.append(_quoted(text))
        if fact is not None:
            value = kinds[kind].format(fact)
            # format_string would print a NULL as text
            parts.append(f"if({fact} IS NULL, NULL, {value})" if kind == "tenth" else value)
    return f"concat({', '.join(parts)})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def insight_report(
    monthly: DataFrame,
    segments: DataFrame,
    churn: DataFrame,
    categories: DataFrame,
    sellers: DataFrame,
    generated_at: dt.datetime,
    title: str = "AUTOMATED INSIGHT REPORT",
    currency: str = "R$",
) -> DataFrame:
    """The written report as ordered (section, seq, line) rows.

    Takes the five KPI views (``segments`` needs segment and monetary).  Each
    view becomes one-row structs of facts, and all lines are text over those.
    The monthly view is needed for two of them, so its few rows are stored first.
    """
    monthly = materialize(monthly)
    found = F.array_sort(F.collect_list(F.struct("month", "direction", "pct_diff", "revenue")))
    facts = _one_row(
        r=revenue_facts(monthly),
        a=revenue_anomalies(monthly).agg(found.alias("rows")),
        s=segment_facts(segment_overview(segments)),
        w=winback_value(churn_overview(churn)),
        c=category_facts(categories),
        v=seller_facts(sellers),
    )
    stamp = generated_at.strftime("%d %b %Y, %H:%M")
    opening = ", ".join(_quoted(x) for x in (title, f"Generated: {stamp}", "=" * 60))
    sections = [f"array({opening})"]
    for n, (heading, lines) in enumerate(REPORT.items(), start=1):
        head = f"array('', {_quoted(f'{n}. {heading}')}, '{'-' * 40}')"
        body = f"array({', '.join(_line(x, currency) for x in lines)})"
        if not lines:
            listed = f"transform(a.rows, x -> {_line(ANOMALY, currency)})"
            body = f"if(size(a.rows) > 0, {listed}, array({_quoted(NO_ANOMALY)}))"
        sections.append(f"concat({head}, {body})")
    numbered = facts.select(F.expr(f"posexplode(array({', '.join(sections)})) AS (section, lines)"))
    lines = numbered.select("section", F.expr("posexplode(lines) AS (seq, line)"))
    # Lines about facts that do not exist (no high-risk customer) are NULL.
    return lines.filter(F.col("line").isNotNull()).orderBy("section", "seq")
