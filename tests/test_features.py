import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tillwise.operators import features, reviews
from test_views import star  # noqa: F401


def test_features_weigh_by_items(star):  # noqa: F811
    got = {r["customer_unique_id"]: r.asDict() for r in features.churn_features(star, dt.date(2020, 8, 1)).collect()}
    u1 = got["u1"]
    assert u1["frequency"] == 2 and u1["monetary"] == 250.0 and u1["avg_order_value"] == 83.33
    assert u1["avg_review_score"] == 5.0 and u1["gave_review"] == 1
    assert u1["active_months"] == 2 and u1["unique_products"] == 2
    assert u1["avg_installments"] == 1.67
    # a price of 0 is left out: (0.1 + 0.25) / 2
    assert u1["avg_freight_ratio"] == 0.175
    assert (u1["max_order_value"], u1["min_order_value"]) == (100.0, 50.0)
    assert set(got) == {"u1", "u2"}
    once = features.churn_features(star, dt.date(2020, 8, 1), dedupe_orders=True)
    by_id = {r["customer_unique_id"]: r["monetary"] for r in once.collect()}
    assert by_id["u1"] == 150.0


def test_reference_date_as_column(star):  # noqa: F811
    ref = features.reference_date(star.orders)
    assert str(ref.first()[0]) == "2020-03-05"
    got = features.churn_features(star, ref.scalar()).collect()
    assert {r["customer_unique_id"]: r["recency_days"] for r in got} == {"u1": 0, "u2": 45}


def test_label_bounds_and_breakdown(frame):
    df = features.churn_label(frame([(180,), (181,), (0,)], "recency_days int"))
    assert [r["churned"] for r in df.collect()] == [0, 1, 0]
    got = {r["churned"]: (r["customers"], r["pct"]) for r in features.churn_breakdown(df).collect()}
    assert got == {0: (2, 66.7), 1: (1, 33.3)}


def test_split_is_exact_and_stable(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("churned"))
    split = features.stratified_split(df, "id")
    counts = {(r["churned"], r["is_test"]): r["count"] for r in split.groupBy("churned", "is_test").count().collect()}
    assert counts[(1, True)] == 67 and counts[(0, True)] == 134
    again = features.stratified_split(df.repartition(7), "id")
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in again.collect()}
    other = features.stratified_split(df, "id", seed=1).filter("is_test")
    assert other.join(split.filter("is_test"), "id").count() < 201


def test_business_impact(frame):
    df = frame([(1, 100.0), (1, 600.0), (0, 900.0)], "churned int, monetary double")
    assert tuple(features.business_impact(df).first()) == (2, 350.0, 105.0, 175.0, 1, 120.0)


def test_correlations(frame):
    df = frame([(1, 2.0, 5), (2, 4.0, 5), (3, 6.5, 5)], "x int, y double, churned int")
    got = {(r["x"], r["y"]): r["corr"] for r in features.correlation_matrix(df, ["x", "y", "churned"]).collect()}
    assert len(got) == 9 and abs(got[("x", "x")] - 1) < 1e-12
    assert got[("x", "y")] == got[("y", "x")] > 0.99 and got[("x", "churned")] is None
    ranked = features.label_correlation(features.correlation_matrix(df, ["x", "y", "churned"]))
    assert [r["feature"] for r in ranked.collect()] == ["x", "y"]


def test_histogram(frame):
    rows = [(0.0, 0), (5.0, 0), (10.0, 0), (999.0, 0), (3.0, 1), (None, 1)]
    df = frame(rows, "v double, churned int")
    plain = {r["bin"]: r["count"] for r in features.clipped_histogram(df, "v", 10, bins=10).collect()}
    assert plain == {0: 1, 3: 1, 5: 1, 9: 2}
    by = {(r["churned"], r["bin"]): r["count"] for r in features.clipped_histogram(df, "v", 10, 10, ["churned"]).collect()}
    assert by == {(0, 0): 1, (0, 5): 1, (0, 9): 2, (1, 5): 1}


def test_eda_stats(frame):
    rows = [(1, 10.0, 0.1234), (0, 20.0, 0.2), (0, 31.0, None)]
    got = features.eda_stats(frame(rows, "churned int, monetary double, avg_freight_ratio double")).first()
    assert tuple(got) == (3, 2, 1, 33.3, 25.5, 10.0, 0.1617)


def test_sentiment(frame):
    scores = [(s,) for s in (0, 1, 2, 3, 4, 5, None)]
    got = [r["sentiment_label"] for r in reviews.sentiment_bucket(frame(scores, "review_score int")).collect()]
    assert got == [None, "Negative", "Negative", "Neutral", "Positive", "Positive", None]
    rows = [(1, 1), (2, 1), (1, 0), (3, 0), (5, 0), (5, 1), (9, 1)]
    df = reviews.sentiment_bucket(frame(rows, "review_score int, churned int"))
    by = reviews.churn_by_sentiment(df)
    assert {tuple(r) for r in by.collect()} == {
        ("Negative", 0.6667, 3, 66.7), ("Neutral", 0.0, 1, 0.0), ("Positive", 0.5, 2, 50.0),
    }
    assert tuple(reviews.sentiment_gap(by).first()) == (66.7, 50.0, 16.7)
    assert [tuple(r) for r in reviews.score_histogram(df).collect()] == [(1, 2), (2, 1), (3, 1), (5, 2), (9, 1)]
    same = frame([(1, 1), (2, 1)], "review_score int, churned int")
    assert reviews.score_churn_corr(same).first()[0] is None


def test_review_recency_is_per_order(star):  # noqa: F811
    got = {r["order_id"]: r for r in reviews.review_churn(star.reviews, star.orders, star.customers, "2020-08-01").collect()}
    assert got["o1"]["recency_days"] == 204 and got["o1"]["churned"] == 1
    assert got["o3"]["customer_unique_id"] == "u2" and len(got) == 2
