import datetime as dt

import pytest

from tillwise.operators import insights


@pytest.fixture(scope="module")
def monthly(spark):
    rows = [(dt.date(2020, m, 1), 10, 9, float(v), 1.0) for m, v in enumerate([100, 100, 110, 90, 0, 100], 1)]
    schema = "month date, total_orders bigint, unique_customers bigint, revenue double, avg_order_value double"
    return spark.createDataFrame(rows, schema)


def test_growth(monthly):
    got = [r["mom_growth"] for r in insights.mom_growth(monthly).orderBy("month").collect()]
    assert got[0] is None and got[1] == 0 and got[5] is None
    assert round(got[2], 6) == 10.0 and got[4] == -100.0


def test_revenue_facts(monthly):
    f = insights.revenue_facts(monthly).first()
    assert (f["total_rev"], f["avg_rev"], f["n_months"]) == (500.0, 83.33, 6)
    assert (str(f["max_month"]), f["max_rev"]) == ("2020-03-01", 110.0)
    assert (str(f["min_month"]), f["min_rev"]) == ("2020-05-01", 0.0)
    assert (f["positive_months"], f["negative_months"]) == (1, 2)
    card = insights.revenue_cards(monthly).first()
    assert str(card["peak_month"]) == "2020-03-01"


def test_first_month_wins_a_tie(monthly):
    f = insights.revenue_facts(monthly.filter("month < '2020-03-01'")).first()
    assert str(f["max_month"]) == str(f["min_month"]) == "2020-01-01"


def test_anomalies(monthly):
    got = insights.revenue_anomalies(monthly).collect()
    assert [(str(r["month"]), r["direction"], r["pct_diff"]) for r in got] == [("2020-05-01", "drop", 100.0)]
    assert insights.revenue_anomalies(monthly.filter("month < '2020-03-01'")).count() == 0


def test_kpis(spark, monthly):
    churn = spark.createDataFrame(
        [("a", "High Risk", 10.0), ("b", "Low Risk", 20.0), ("c", "High Risk", 30.01)],
        "customer_unique_id string, churn_risk_label string, total_spent double",
    )
    got = insights.kpi_summary(monthly, churn, churn).first()
    assert tuple(got) == (500.0, 60, 3, 2)
    overview = insights.churn_overview(churn)
    first = overview.first()
    assert tuple(first) == ("High Risk", 2, 20.01)
    won = insights.winback_value(overview).first()
    assert (won["high_risk_customers"], won["avg_spend"], won["recoverable_revenue"]) == (2, 20.01, 6.0)


def test_segments_and_actions(spark):
    rows = [("Champions", 10.0), ("Champions", 20.0), ("At Risk", 99.0), ("Else", 1.0)]
    seg = spark.createDataFrame(rows, "segment string, monetary double")
    over = insights.segment_overview(seg)
    assert [r["segment"] for r in over.collect()] == ["At Risk", "Champions", "Else"]
    f = insights.segment_facts(over).first()
    assert (f["total_customers"], f["n_segments"], f["largest_segment"]) == (4, 3, "Champions")
    assert (f["largest_share_pct"], f["best_segment"], f["best_avg_monetary"]) == (50.0, "At Risk", 99.0)
    acts = {r["segment"]: r["action"] for r in insights.segment_actions(over).collect()}
    assert acts["Else"] == insights.DEFAULT_ACTION and "VIP" in acts["Champions"]


CATEGORIES = "category string, total_orders bigint, total_revenue double, avg_order_value double, avg_review_score double"
SELLERS = "seller_id string, late_pct double, risk_rating string"


def test_report(spark, monthly):
    seg = spark.createDataFrame([("Champions", 1234.5)], "segment string, monetary double")
    churn = spark.createDataFrame([("High Risk", 1000.0)], "churn_risk_label string, total_spent double")
    cats = spark.createDataFrame([("toys", 2, 20.0, 10.0, 4.5), ("books", 1, 10.0, 10.0, 3.0)], CATEGORIES)
    sellers = spark.createDataFrame([("s", 30.0, "Medium Risk")], SELLERS)
    at = dt.datetime(2020, 8, 1, 9, 5)
    rows = insights.insight_report(monthly, seg, churn, cats, sellers, at).collect()
    lines = [r["line"] for r in rows]
    assert lines[1] == "Generated: 01 Aug 2020, 09:05"
    assert [(r["section"], r["seq"]) for r in rows] == sorted((r["section"], r["seq"]) for r in rows)
    text = "\n".join(lines)
    assert "The platform generated R$500.00 in total revenue across 6 months" in text
    assert "ANOMALY DETECTED: May 2020 shows a revenue drop of 100.0%" in text
    assert "could recover R$150.00 in revenue" in text
    assert "Peak revenue was recorded in March 2020 at R$110.00" in text
    assert "'books' has the lowest review score (3.0)" in text
    assert "The 1 medium-risk sellers show" in text

    calm = insights.insight_report(
        monthly.filter("month < '2020-03-01'"), seg, churn.filter("false"), cats, sellers.filter("false"), at
    )
    text = "\n".join(r["line"] for r in calm.collect())
    assert "No significant revenue anomalies detected." in text
    assert "classified as High Risk" not in text and "medium-risk sellers show" not in text


def test_seller_figures(spark):
    df = spark.createDataFrame([("a", 60.0, "High Risk"), ("b", 30.0, "Medium Risk"), ("c", 1.0, "Good")], SELLERS)
    assert tuple(insights.seller_facts(df).first()) == (1, 1)
    worst = insights.worst_sellers(df, 2)
    assert [r["seller_id"] for r in worst.collect()] == ["a", "b"]
    assert insights.seller_risk_counts(worst).count() == 2
