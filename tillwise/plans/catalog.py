"""Every operator as a query over the order-trade test tables.

A query takes (spark, folder) and reads the whole tables.  Cleaning is part of
each plan, so a query is the full way from raw tables to its result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.ml import boost, classify, cluster, explain, forecast, forest, metrics
from tillwise.ml.trees import binned_rows
from tillwise.operators import analytics, clean, features, insights, quality, rfm, reviews, views
from tillwise.operators.features import FEATURES, LABEL
from tillwise.operators.skew import spread_join
from tillwise.session import materialize, scratch_path
from tillwise.sources.star import Star, load_star, write_star
from tillwise.sources.trade import TradeTables, trade_star

Query = Callable[[SparkSession, str], DataFrame]

# The test data starts in 1995, has a last order in 2001 and amounts near one million.
COHORT_START = "1995-01-01"
FORECAST_AFTER = "2001-01-01"
SPEND_CLIP = 1_000_000
GENERATED_AT = dt.datetime(2001, 8, 1, 12, 0)

# The boosted stumps that SQL can follow: few values per feature, each of them a cut.
STUMP_FEATURES = ["frequency", "active_months", "unique_products"]
STUMP_CUTS = 60
STUMP_ROUNDS = 3


def portable(df: DataFrame) -> DataFrame:
    """Plain column types, so that two engines can be compared value by value."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind.startswith("decimal") or kind == "float":
            c = c.cast("double")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


class Retail:
    """Frames of one folder, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str, star: Star | None = None):
        self.spark, self.folder, self.own_star = spark, folder, star is None
        self.raw = TradeTables(spark, folder)
        self.star = star or trade_star(self.raw)

    @property
    def facts(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.star.customers, self.star.orders, self.star.payments

    @property
    def paid(self) -> tuple[DataFrame, DataFrame]:
        return self.star.orders, self.star.payments

    @property
    def as_of(self):
        return features.reference_date(self.star.orders).scalar()

    def monthly(self) -> DataFrame:
        return views.v_monthly_revenue(*self.paid)

    def churn(self) -> DataFrame:
        return views.v_churn_risk(*self.facts, self.as_of)

    def rfm(self) -> DataFrame:
        return rfm.rfm_base(*self.facts, self.as_of)

    def scored(self) -> DataFrame:
        return rfm.rfm_scored(self.rfm())

    def segments(self) -> DataFrame:
        return views.v_rfm_segments(*self.facts, self.as_of)

    def categories(self) -> DataFrame:
        return views.v_category_performance(self.star)

    def sellers(self) -> DataFrame:
        return views.v_seller_risk(self.star)

    def features(self) -> DataFrame:
        return features.churn_features(self.star, self.as_of)

    def labelled(self) -> DataFrame:
        return features.churn_label(self.features())

    def complete(self) -> DataFrame:
        """Labelled customers without NULL features, stored: several passes read them."""
        return materialize(clean.drop_incomplete(self.labelled(), FEATURES))

    def split(self) -> tuple[DataFrame, DataFrame]:
        rows = features.stratified_split(self.complete(), "customer_unique_id")
        return rows.filter(~F.col("is_test")), rows.filter("is_test")

    def reviews(self) -> DataFrame:
        s = self.star
        return reviews.review_churn(s.reviews, s.orders, s.customers, self.as_of)

    def sentiment(self) -> DataFrame:
        return reviews.sentiment_bucket(self.reviews())

    def score_rows(self) -> DataFrame:
        """A fixed score with ties: fewer orders, higher score."""
        return materialize(
            clean.drop_incomplete(self.labelled(), FEATURES).select(
                F.col(LABEL).alias("label"),
                (F.lit(1.0) / (1 + F.col("frequency"))).alias("score"),
                F.when(F.col("frequency") <= 4, 1).otherwise(0).alias("prediction"),
            )
        )

    def banded(self) -> DataFrame:
        """Customers with a fixed cluster number."""
        return self.rfm().withColumn("cluster", F.least("frequency", F.lit(3)))

    def states(self) -> DataFrame:
        """order_id with the region of its customer."""
        orders = self.star.orders.select("order_id", "customer_id")
        placed = self.star.customers.select("customer_id", "customer_state")
        owned = spread_join(orders, placed, "customer_id", ["order_id"])
        return owned.select("order_id", "customer_state")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Floating-point means to 6 digits: their last bits depend on the order of addition."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _parse_timestamps(r: Retail) -> DataFrame:
    text = {c: F.col(c).cast("string") for c in clean.ORDER_DATES}
    as_read = r.raw["orders"].withColumns(text)
    return clean.parse_timestamps(as_read, clean.ORDER_DATES).select("order_id", *clean.ORDER_DATES)


def _foreign_keys(r: Retail) -> DataFrame:
    items, s = r.star.items, r.star
    checks = {
        "items_orders": (s.orders, "order_id"),
        "items_products": (s.products, "product_id"),
        "items_sellers": (s.sellers, "seller_id"),
    }
    found = [
        quality.check_foreign_key(items, parent, key).select(
            F.lit(name).alias("name"), F.col(key).alias("key"), "n_rows"
        )
        for name, (parent, key) in checks.items()
    ]
    return reduce(DataFrame.unionByName, found)


def _profile_all(r: Retail) -> DataFrame:
    """Profile of every raw table."""
    found = [
        quality.profile_table(r.raw[name]).select(F.lit(name).alias("table"), "*") for name in r.raw
    ]
    return reduce(DataFrame.unionByName, found)


def _unique_keys(r: Retail) -> DataFrame:
    """Rows of the star that break one of its four unique keys, with one key that is broken."""
    s = r.star
    checks = {
        "customers": (s.customers, "customer_id"),
        "orders": (s.orders, "order_id"),
        "products": (s.products, "product_id"),
        "sellers": (s.sellers, "seller_id"),
        "items": (s.items, "order_id"),
    }
    found = [
        quality.check_unique(table, [key]).select(
            F.lit(name).alias("name"), F.col(key).alias("key"), "n"
        )
        for name, (table, key) in checks.items()
    ]
    return reduce(DataFrame.unionByName, found)


def _report(r: Retail) -> DataFrame:
    return insights.insight_report(
        r.monthly(), r.segments(), r.churn(), r.categories(), r.sellers(), GENERATED_AT
    )


_ONCE: dict[tuple[str, str, str], DataFrame] = {}


def _once(r: Retail, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored frame that several model queries read, built once per application and folder.

    The tables of a folder are taken not to change while the application runs.
    """
    if not r.own_star:
        return materialize(build())
    key = (r.spark.sparkContext.applicationId, r.folder, name)
    if key not in _ONCE:
        _ONCE[key] = materialize(build())
    return _ONCE[key]


def _parted(r: Retail) -> tuple[DataFrame, DataFrame]:
    """Stored train and test rows."""

    def build() -> DataFrame:
        train, test = r.split()
        return train.unionByName(test)

    rows = _once(r, "parted", build)
    return rows.filter(~F.col("is_test")), rows.filter("is_test")


def _folded(r: Retail) -> DataFrame:
    train, _ = _parted(r)
    return classify.with_folds(classify.with_weights(train), "customer_unique_id")


def _model_benchmark(r: Retail) -> DataFrame:
    return _once(r, "benchmark", lambda: classify.benchmark_models(*_parted(r)))


def _review_parts(r: Retail) -> tuple[DataFrame, DataFrame]:
    rows = materialize(clean.drop_incomplete(r.reviews(), ["review_score", LABEL]))
    split = features.stratified_split(rows, "order_id")
    return split.filter(~F.col("is_test")), split.filter("is_test")


def _score_only_gain(r: Retail) -> DataFrame:
    full_auc = classify.champion(_model_benchmark(r)).first()["AUC-ROC"]
    return classify.score_only_model(*_review_parts(r), full_auc)


def _cross_validate(r: Retail) -> DataFrame:
    return classify.cross_validate(materialize(_folded(r)))


def _grid_search(r: Retail) -> DataFrame:
    return _once(r, "grid", lambda: classify.grid_search(materialize(_folded(r)))[0])


def _tuned_gain(r: Retail) -> DataFrame:
    """Test AUC of the best forest of the grid and its gain on the champion."""
    best = forest.best_rule(forest.best_first(_grid_search(r)), len(FEATURES))
    tuned = classify.RandomForest(FEATURES, *best)
    return classify.tuned_gain(tuned, *_parted(r), _model_benchmark(r))


def _forest(r: Retail) -> forest.Forest:
    train, _ = _parted(r)
    return forest.fit_forest(train, FEATURES, "customer_unique_id", LABEL)


def _explain(r: Retail) -> DataFrame:
    return explain.explain_forest(_forest(r), _parted(r)[1], "customer_unique_id")


def _explained_sums(r: Retail) -> DataFrame:
    """Test rows explained, and those whose attributions do not add up to their score within 1e-9."""
    test, model = _parted(r)[1], _forest(r)
    rows = explain.explain_rows(model, test, "customer_unique_id")
    total = F.aggregate("phi", F.col("base"), lambda a, x: a + x)
    both = rows.select(F.xxhash64("customer_unique_id").alias("row"), total.alias("total")).join(
        model.scores(test, "customer_unique_id"), "row"
    )
    off = F.count_if(F.abs(F.col("total") - F.col("score")) > 1e-9)
    return both.agg(F.count("*").alias("n_rows"), off.alias("n_off"))


def _boosted_stumps(r: Retail) -> DataFrame:
    """Margins of second-order boosting with one split a tree, over all customers."""
    rows = r.complete().withColumn("fold", F.lit(0))
    cuts = [np.arange(1, STUMP_CUTS + 1, dtype=float)] * len(STUMP_FEATURES)
    binned = binned_rows(rows, STUMP_FEATURES, cuts, "customer_unique_id", LABEL)
    how = boost.Boosting(rounds=STUMP_ROUNDS, depth=1)
    fitted = boost.boost(materialize(binned), len(STUMP_FEATURES), [0], how)
    ids = rows.select("customer_unique_id", F.xxhash64("customer_unique_id").alias("row"))
    return ids.join(fitted.rows, "row").select(
        "customer_unique_id", F.round(F.col("margin")[0], 6).alias("margin")
    )


def _clusters_settled(r: Retail) -> DataFrame:
    """Rows assigned, clusters in use, and rows nearer to another cluster's mean by over 1 %."""
    z = [f"z_{c}" for c in cluster.RFM_COLUMNS]
    rows = cluster.standardize(materialize(cluster.kmeans_assign(r.rfm(), 3)), cluster.RFM_COLUMNS)
    means = rows.groupBy("cluster").agg(*[F.avg(c).alias(f"m{c}") for c in z])
    far = reduce(Column.__add__, [F.pow(F.col(c) - F.col(f"m{c}"), F.lit(2.0)) for c in z])
    listed = means.agg(F.collect_list(F.struct("*"))).scalar()  # three rows
    each = rows.withColumn("_all", listed).select("*", F.inline("_all").alias("other", *[f"m{c}" for c in z]))
    per_row = each.groupBy("customer_unique_id", "cluster").agg(
        F.min(far).alias("least"), F.min(F.when(F.col("other") == F.col("cluster"), far)).alias("own")
    )
    return per_row.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("cluster").alias("n_clusters"),
        F.count_if(F.col("own") > 1.01 * F.col("least") + 1e-9).alias("n_off"),
    )


def _forecast(r: Retail) -> DataFrame:
    series = forecast.weekly_revenue(*r.paid, keys=r.states())
    return forecast.forecast_revenue(series, ["customer_state"])


def _stored_star(r: Retail) -> DataFrame:
    """Revenue over the star after writing and loading it."""
    folder = scratch_path(r.spark)
    write_star(r.star, folder)
    stored = load_star(r.spark, folder)
    return views.v_monthly_revenue(stored.orders, stored.payments)


def _view_sql(r: Retail) -> DataFrame:
    """SQL over registered views and tables."""
    views.register_views(r.spark, r.star, r.as_of)
    return r.spark.sql(
        """SELECT v.churn_risk_label, c.customer_state, count(*) AS customers
        FROM v_churn_risk v JOIN dim_customers c ON v.customer_unique_id = c.customer_unique_id
        GROUP BY 1, 2"""
    )


def _published_segments(r: Retail) -> DataFrame:
    """The registered segment view over stored boundaries."""
    views.refresh_views(r.spark, r.star, r.as_of, scratch_path(r.spark))
    return r.spark.table("v_rfm_segments")


def _cluster_segments(r: Retail) -> DataFrame:
    return insights.cluster_actions(cluster.cluster_segments(r.rfm()))


def _weekly_as_forecast(r: Retail) -> DataFrame:
    return forecast.weekly_revenue(*r.paid).withColumnRenamed("y", "yhat")


_FEATURE_OUT = ["customer_unique_id", "recency_days", *FEATURES]

_BUILDERS: dict[str, Callable[[Retail], DataFrame]] = {
    # cleaning and quality
    "profile_orders": lambda r: quality.profile_table(r.raw["orders"]),
    "clean_customers": lambda r: r.star.customers,
    "parse_timestamps": _parse_timestamps,
    "filter_delivered": lambda r: clean.filter_delivered(r.raw["orders"]).select(
        "order_id", "customer_id", "order_status"
    ),
    "delivery_delay_days": lambda r: clean.delivery_delay_days(r.raw["orders"]).select(
        "order_id", "delivery_delay_days"
    ),
    "item_total_value": lambda r: clean.item_total_value(r.raw["order_items"]).drop(
        "shipping_limit_date"
    ),
    "aggregate_payments": lambda r: clean.aggregate_payments(r.raw["payments"]),
    "translate_category": lambda r: clean.translate_category(
        r.raw["products"], r.raw["category"]
    ).select("product_id", "product_category_name", "product_category_name_english"),
    "fill_unknown": lambda r: r.star.products,
    "clean_reviews": lambda r: r.star.reviews,
    "drop_incomplete": lambda r: clean.drop_incomplete(r.features(), FEATURES).select(*_FEATURE_OUT),
    "profile_all": _profile_all,
    "check_unique_star": _unique_keys,
    "check_unique": lambda r: quality.check_unique(
        r.raw["payments"], ["order_id", "payment_sequential"]
    ),
    "check_foreign_key": _foreign_keys,
    "orphan_orders": lambda r: quality.orphan_orders(r.star.orders, r.star.customers),
    "single_purchase_rate": lambda r: quality.single_purchase_rate(r.features()),
    "load_star": _stored_star,
    "register_views": _view_sql,
    "published_segments": _published_segments,
    # analysis queries and views
    "rfm_base": lambda r: rfm.rfm_base(*r.facts, r.as_of, by_place=True),
    "rfm_scored": lambda r: r.scored(),
    "rfm_scored_five_is_best": lambda r: rfm.rfm_scored(r.rfm(), five_is_best=True),
    "rfm_segments": lambda r: rfm.rfm_segments(r.scored()),
    "rfm_summary": lambda r: rfm.rfm_summary(
        rfm.rfm_segments(rfm.rfm_scored(rfm.rfm_base(*r.facts, r.as_of, by_place=True)))
    ),
    "cohort_retention": lambda r: analytics.cohort_retention(
        r.star.customers, r.star.orders, COHORT_START
    ),
    "revenue_trends": lambda r: analytics.revenue_trends(*r.paid),
    "top_categories": lambda r: analytics.top_categories(r.star),
    "top_categories_three": lambda r: analytics.top_categories(r.star, limit=3),
    "seller_delivery": lambda r: analytics.seller_delivery(r.star),
    "order_funnel": lambda r: analytics.order_funnel(r.raw["orders"]),
    "v_monthly_revenue": lambda r: r.monthly(),
    "v_churn_risk": lambda r: r.churn(),
    "v_rfm_segments": lambda r: r.segments(),
    "v_category_performance": lambda r: r.categories(),
    "v_category_performance_per_order": lambda r: views.v_category_performance(
        r.star, dedupe_orders=True
    ),
    "v_seller_risk": lambda r: r.sellers(),
    "v_seller_risk_tight": lambda r: views.v_seller_risk(r.star, high=38, medium=33),
    # dashboard and report
    "kpi_summary": lambda r: insights.kpi_summary(r.monthly(), r.churn(), r.rfm()),
    "segment_overview": lambda r: insights.segment_overview(r.segments()),
    "churn_overview": lambda r: insights.churn_overview(r.churn()),
    "top_n_categories": lambda r: insights.top_n_categories(r.categories()),
    "worst_sellers": lambda r: insights.worst_sellers(r.sellers()),
    "seller_risk_counts": lambda r: insights.seller_risk_counts(r.sellers()),
    "seller_risk_counts_worst": lambda r: insights.seller_risk_counts(
        insights.worst_sellers(r.sellers())
    ),
    "customer_sample": lambda r: insights.customer_sample(r.segments()),
    "customer_sample_hundred": lambda r: insights.customer_sample(r.segments(), n=100),
    "mom_growth": lambda r: _rounded(insights.mom_growth(r.monthly()), "mom_growth"),
    "revenue_cards": lambda r: insights.revenue_cards(r.monthly()),
    "segment_actions": lambda r: insights.segment_actions(
        insights.segment_overview(r.segments())
    ).select("segment", "customer_count", "action"),
    "revenue_facts": lambda r: _rounded(insights.revenue_facts(r.monthly()), "avg_growth"),
    "revenue_anomalies": lambda r: insights.revenue_anomalies(r.monthly()),
    "segment_facts": lambda r: insights.segment_facts(insights.segment_overview(r.segments())),
    "winback_value": lambda r: insights.winback_value(insights.churn_overview(r.churn())),
    "category_facts": lambda r: insights.category_facts(r.categories()),
    "seller_facts": lambda r: insights.seller_facts(r.sellers()),
    "insight_report": _report,
    # features and evaluation
    "reference_date": lambda r: features.reference_date(r.star.orders),
    "churn_features": lambda r: r.features().select(*_FEATURE_OUT),
    "churn_label": lambda r: r.labelled().select("customer_unique_id", "recency_days", LABEL),
    "churn_breakdown": lambda r: features.churn_breakdown(r.labelled()),
    "stratified_split": lambda r: features.stratified_split(
        r.complete(), "customer_unique_id"
    ).select("customer_unique_id", LABEL, "is_test"),
    "classification_metrics": lambda r: metrics.classification_metrics(r.score_rows()),
    "roc_curve": lambda r: metrics.roc_curve(r.score_rows(), "label", "score"),
    "business_impact": lambda r: features.business_impact(
        clean.drop_incomplete(r.labelled(), FEATURES)
    ),
    "correlation_matrix": lambda r: _rounded(
        features.correlation_matrix(
            clean.drop_incomplete(r.labelled(), FEATURES), [*FEATURES, LABEL]
        ),
        "corr",
    ),
    "label_correlation": lambda r: _rounded(
        features.label_correlation(
            features.correlation_matrix(
                clean.drop_incomplete(r.labelled(), FEATURES), [*FEATURES, LABEL]
            )
        ),
        "corr",
    ),
    "clipped_histogram": lambda r: features.clipped_histogram(
        r.complete(), "monetary", SPEND_CLIP, by=[LABEL]
    ),
    "clipped_histogram_freight": lambda r: features.clipped_histogram(
        r.complete(), "avg_freight_ratio", 2
    ),
    "eda_stats": lambda r: features.eda_stats(clean.drop_incomplete(r.labelled(), FEATURES)),
    "review_churn": lambda r: r.reviews(),
    "sentiment_bucket": lambda r: r.sentiment().select(
        "order_id", "review_score", "sentiment_label"
    ),
    "sentiment_distribution": lambda r: reviews.sentiment_distribution(r.sentiment()),
    "churn_by_sentiment": lambda r: reviews.churn_by_sentiment(r.sentiment()),
    "sentiment_gap": lambda r: reviews.sentiment_gap(reviews.churn_by_sentiment(r.sentiment())),
    "score_churn_corr": lambda r: _rounded(reviews.score_churn_corr(r.reviews()), "corr"),
    "score_histogram": lambda r: reviews.score_histogram(r.reviews()),
    # clusters and series
    "standardize": lambda r: _rounded(
        cluster.standardize(materialize(r.rfm()), cluster.RFM_COLUMNS).drop(*cluster.RFM_COLUMNS),
        *[f"z_{c}" for c in cluster.RFM_COLUMNS],
    ),
    "cluster_profile": lambda r: cluster.cluster_profile(r.banded()),
    "cluster_label": lambda r: cluster.cluster_label(
        cluster.cluster_profile(r.banded())
    ).select("cluster", "label"),
    "cluster_actions": lambda r: insights.cluster_actions(
        cluster.cluster_label(cluster.cluster_profile(r.banded()))
    ).select("cluster", "label", "action"),
    "weekly_revenue": lambda r: forecast.weekly_revenue(*r.paid),
    "forecast_summary": lambda r: forecast.forecast_summary(_weekly_as_forecast(r), FORECAST_AFTER),
    # fitted models
    "model_benchmark": _model_benchmark,
    "champion": lambda r: classify.champion(_model_benchmark(r)),
    "cross_validate": _cross_validate,
    "grid_search": _grid_search,
    "tuned_gain": _tuned_gain,
    "score_only_model": lambda r: classify.score_only_model(*_review_parts(r)),
    "score_only_gain": _score_only_gain,
    "boosted_stumps": _boosted_stumps,
    "explain_forest": _explain,
    "explained_sums": _explained_sums,
    "kmeans_scan": lambda r: cluster.kmeans_scan(r.rfm()),
    "kmeans_assign": lambda r: cluster.kmeans_assign(r.rfm(), 3),
    "clusters_settled": _clusters_settled,
    "cluster_segments": _cluster_segments,
    "forecast_revenue": _forecast,
}


def _query(build: Callable[[Retail], DataFrame]) -> Query:
    return lambda spark, folder: portable(build(Retail(spark, folder)))


def on_star(name: str, spark: SparkSession, folder: str, star: Star) -> DataFrame:
    """A query over a star that is already stored."""
    return portable(_BUILDERS[name](Retail(spark, folder, star)))


def catalog() -> dict[str, Query]:
    return {name: _query(build) for name, build in _BUILDERS.items()}
