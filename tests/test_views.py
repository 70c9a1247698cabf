"""KPI views and analysis queries on a hand-made star."""

import datetime as dt
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from tillwise.operators import analytics, rfm, views
from tillwise.sources.star import Star

D = Decimal


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def star(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    return Star(
        customers=df(
            [("c1", "u1", "X", "S"), ("c2", "u2", "Y", "T")],
            "customer_id string, customer_unique_id string, customer_city string, customer_state string",
        ),
        products=df(
            [("p1", "toys"), ("p2", "unknown")],
            "product_id string, product_category_name_english string",
        ),
        sellers=df(
            [("s1", "X", "S"), ("s2", "Y", "T")],
            "seller_id string, seller_city string, seller_state string",
        ),
        orders=df(
            [
                ("o1", "c1", ts("2020-01-10"), 2),
                ("o2", "c1", ts("2020-03-05"), None),
                ("o3", "c2", ts("2020-01-20"), -1),
                ("o4", "gone", ts("2020-02-01"), 0),
            ],
            "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz, "
            "delivery_delay_days int",
        ),
        items=df(
            [
                ("o1", "p1", "s1", D("10.00"), D("1.00")),
                ("o1", "p1", "s1", D("0.00"), D("1.00")),
                ("o2", "p2", "s1", D("20.00"), D("5.00")),
                ("o3", "p1", "s2", D("30.00"), D("3.00")),
            ],
            "order_id string, product_id string, seller_id string, price decimal(18,2), "
            "freight_value decimal(18,2)",
        ),
        payments=df(
            [("o1", D("100.00"), 2), ("o2", D("50.00"), 1), ("o3", D("33.00"), 3), ("o4", D("7.00"), 1)],
            "order_id string, total_payment decimal(18,2), installments int",
        ),
        reviews=df([("o1", 5), ("o3", 2)], "order_id string, review_score int"),
    )


AS_OF = dt.date(2020, 8, 1)


def table(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_monthly_revenue_and_growth(star):
    got = table(views.v_monthly_revenue(star.orders, star.payments), "month")
    january = got[dt.date(2020, 1, 1)]
    assert (january["total_orders"], january["unique_customers"]) == (2, 2)
    assert (january["revenue"], january["avg_order_value"]) == (133.0, 66.5)
    trend = analytics.revenue_trends(star.orders, star.payments).collect()
    assert [r["month"] for r in trend] == ["2020-01", "2020-02", "2020-03"]
    assert [r["mom_growth_pct"] for r in trend] == [None, -94.7, 614.3]


def test_growth_from_zero_is_null(spark):
    orders = spark.createDataFrame(
        [("a", "c", ts("2020-01-01")), ("b", "c", ts("2020-02-01")), ("d", "c", ts("2020-03-01"))],
        "order_id string, customer_id string, order_purchase_timestamp timestamp_ntz",
    )
    pay = spark.createDataFrame(
        [("a", D("0"), 1), ("b", D("50"), 1), ("d", D("100"), 1)],
        "order_id string, total_payment decimal(18,2), installments int",
    )
    got = analytics.revenue_trends(orders, pay).collect()
    assert [r["mom_growth_pct"] for r in got] == [None, None, 100.0]


def test_churn_risk_bounds(star):
    got = table(views.v_churn_risk(star.customers, star.orders, star.payments, AS_OF), "customer_unique_id")
    assert got["u1"]["total_orders"] == 2 and got["u1"]["total_spent"] == 150.0
    assert got["u1"]["days_since_last_order"] == 149
    assert got["u1"]["churn_risk_label"] == "Medium Risk"
    assert got["u2"]["churn_risk_label"] == "High Risk"
    days = star.orders.sparkSession.createDataFrame([(180,), (181,), (90,), (91,)], "d int")
    labels = [r[0] for r in days.select(views.churn_risk_label(F.col("d"))).collect()]
    assert labels == ["Medium Risk", "High Risk", "Low Risk", "Medium Risk"]


def test_category_counts_a_payment_per_item(star):
    got = table(views.v_category_performance(star), "category")
    assert got["toys"] == {
        "category": "toys",
        "total_orders": 2,
        "total_revenue": 233.0,
        "avg_order_value": 77.67,
        "avg_review_score": 4.0,
    }
    assert got["unknown"]["avg_review_score"] is None
    once = table(views.v_category_performance(star, dedupe_orders=True), "category")
    assert once["toys"]["total_revenue"] == 133.0 and once["toys"]["avg_review_score"] == 3.5
    top = analytics.top_categories(star, limit=1).collect()
    assert [(r["category"], r["revenue_rank"]) for r in top] == [("toys", 1)]


def test_late_share_may_pass_one_hundred(star):
    got = table(views.v_seller_risk(star, min_orders=1), "seller_id")
    assert got["s1"]["total_orders"] == 2 and got["s1"]["late_pct"] == 100.0
    assert got["s1"]["avg_delay_days"] == 2.0 and got["s1"]["risk_rating"] == "High Risk"
    one_order = Star(**{n: getattr(star, n) for n in ("customers", "products", "sellers", "orders", "payments", "reviews")}, items=star.items.filter("order_id = 'o1'"))
    assert views.v_seller_risk(one_order, min_orders=1).first()["late_pct"] == 200.0
    assert views.v_seller_risk(star).count() == 0
    assert analytics.seller_delivery(star, min_orders=1, limit=1).first()["late_deliveries"] == 2


def test_cohorts_have_no_row_for_a_silent_month(star):
    got = analytics.cohort_retention(star.customers, star.orders, "2020-01-01").collect()
    assert [(r["cohort"], r["month_number"], r["customers"], r["cohort_size"], r["retention_rate"]) for r in got] == [
        ("2020-01", 0, 2, 2, 100.0),
        ("2020-01", 2, 1, 2, 50.0),
    ]
    assert analytics.cohort_retention(star.customers, star.orders, "2020-02-01").count() == 0
    assert analytics.cohort_retention(star.customers, star.orders, "2020-01-01", 1).count() == 1


def test_funnel(spark):
    t = ts
    rows = [
        (t("2020-01-01"), t("2020-01-01 10:00:00"), t("2020-01-02 10:00:00"), t("2020-01-03 10:00:00")),
        (t("2020-01-01"), t("2020-01-01 11:00:00"), None, None),
        (t("2020-01-01"), None, None, None),
    ]
    schema = (
        "order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
        "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz"
    )
    got = analytics.order_funnel(spark.createDataFrame(rows, schema)).first().asDict()
    assert [got[f"stage_{i}"] for i in ("1_placed", "2_approved", "3_dispatched", "4_delivered")] == [3, 2, 1, 1]
    assert got["pct_approved"] == 66.7 and got["drop_placed_to_approved"] == 1
    assert got["avg_hours_to_approval"] == 10.5 and got["avg_total_fulfillment_hours"] == 58.5
    empty = analytics.order_funnel(spark.createDataFrame([], schema)).first()
    assert empty["stage_1_placed"] == 0 and empty["pct_approved"] is None


def test_all_score_triples(spark):
    triples = list(product(range(1, 6), repeat=3))
    df = spark.createDataFrame(triples, "r_score int, f_score int, m_score int")
    got = {r["segment"]: r["count"] for r in rfm.rfm_segments(df).groupBy("segment").count().collect()}
    assert got == {
        "Potential Loyalists": 52,
        "Loyal Customers": 43,
        "Need Attention": 19,
        "Champions": 10,
        "New Customers": 1,
    }


def test_rfm(star):
    base = rfm.rfm_base(star.customers, star.orders, star.payments, AS_OF, by_place=True)
    assert base.columns[:3] == ["customer_unique_id", "customer_city", "customer_state"]
    got = table(base, "customer_unique_id")
    assert got["u1"]["recency_days"] == 149 and got["u1"]["monetary"] == 150.0
    scored = table(rfm.rfm_scored(base), "customer_unique_id")
    assert (scored["u1"]["r_score"], scored["u1"]["f_score"], scored["u1"]["m_score"]) == (1, 1, 1)
    turned = table(rfm.rfm_scored(base, five_is_best=True), "customer_unique_id")
    assert turned["u1"]["r_score"] == 5
    summary = rfm.rfm_summary(rfm.rfm_segments(rfm.rfm_scored(base))).collect()
    assert sum(r["customer_count"] for r in summary) == 2
    assert sum(r["total_revenue"] for r in summary) == 183.0


def test_undated_orders_only_count_in_the_view(spark, star):
    undated = spark.createDataFrame([("o9", "c2", None, None)], star.orders.schema)
    orders = star.orders.union(undated)
    pay = star.payments.union(spark.createDataFrame([("o9", D("1.00"), 1)], star.payments.schema))
    view = table(rfm.rfm_base(star.customers, orders, pay, AS_OF), "customer_unique_id")
    query = table(rfm.rfm_base(star.customers, orders, pay, AS_OF, by_place=True), "customer_unique_id")
    assert view["u2"]["frequency"] == 2 and query["u2"]["frequency"] == 1


def test_views_answer_sql(spark, star):
    names = views.register_views(spark, star, AS_OF)
    assert "v_rfm_segments" in names and "fact_orders" in names
    top = spark.sql("SELECT category FROM v_category_performance ORDER BY total_revenue DESC LIMIT 1")
    assert top.first()[0] == "toys"
    assert spark.sql("SELECT count(*) FROM v_rfm_segments").first()[0] == 2


def test_published_views_run_no_job_and_follow_a_refresh(spark, star, tmp_path):
    from tillwise.sources.star import TABLES, Star

    folder = str(tmp_path / "bounds")
    views.refresh_views(spark, star, AS_OF, folder)
    plain = table(views.v_rfm_segments(star.customers, star.orders, star.payments, AS_OF), "customer_unique_id")
    assert table(spark.table("v_rfm_segments"), "customer_unique_id") == plain
    spark.sparkContext.setJobGroup("registering", "")
    views.register_views(spark, star, AS_OF, folder)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("registering")) == []
    spark.sparkContext.setJobGroup("after", "")
    more = {
        "customers": [(f"n{i}", f"v{i}", None, "X", "S") for i in range(8)],
        "orders": [(f"no{i}", f"n{i}") for i in range(8)],
        "payments": [(f"no{i}", D(f"{i}.50")) for i in range(8)],
    }
    grown = {name: getattr(star, name) for name in TABLES}
    for name, rows in more.items():
        old = grown[name]
        keep = {"customers": ["customer_id", "customer_unique_id"], "orders": ["order_id", "customer_id"]}
        cols = keep.get(name, ["order_id", "total_payment"])
        new = spark.createDataFrame([r[: len(cols)] for r in rows], old.select(*cols).schema)
        grown[name] = old.unionByName(new, allowMissingColumns=True)
    at = F.coalesce("order_purchase_timestamp", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))
    grown["orders"] = grown["orders"].withColumn("order_purchase_timestamp", at)
    grown = Star(**grown)
    views.refresh_views(spark, grown, AS_OF, folder)
    assert spark.table("v_rfm_segments").count() == 10
    wanted = views.v_rfm_segments(grown.customers, grown.orders, grown.payments, AS_OF)
    assert table(spark.table("v_rfm_segments"), "customer_unique_id") == table(wanted, "customer_unique_id")
