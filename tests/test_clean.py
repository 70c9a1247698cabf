from decimal import Decimal

from pyspark.errors import PySparkException
import pytest

from tillwise.operators import clean, quality


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_customers_keep_the_first_row_in_any_input_order(frame):
    data = [("c2", "u1", "B", "y"), ("c1", "u1", "A", "x"), ("c3", "u2", "C", "z")]
    schema = "customer_id string, customer_unique_id string, customer_city string, customer_state string"
    want = [("c1", "u1", "A", "x"), ("c3", "u2", "C", "z")]
    assert rows(clean.clean_customers(frame(data, schema)), "customer_id") == want
    assert rows(clean.clean_customers(frame(data[::-1], schema).repartition(3)), "customer_id") == want


def test_first_row_follows_the_given_order(frame):
    data = [("c1", "u1", 5), ("c2", "u1", 1)]
    df = frame(data, "customer_id string, customer_unique_id string, row_order int")
    assert rows(clean.clean_customers(df, ["row_order"]), "customer_id") == [("c2", "u1", 1)]


def test_orphans_and_id_map(frame):
    customers = frame(
        [("c1", "u1"), ("c2", "u1"), ("c3", "u3")], "customer_id string, customer_unique_id string"
    )
    orders = frame([(1, "c1"), (2, "c2"), (3, "c2")], "order_id int, customer_id string")
    kept = clean.clean_customers(customers)
    assert rows(quality.orphan_orders(orders, kept), "customer_id") == [("c2", 2)]
    mapped = clean.customer_id_map(customers).select("customer_id", "kept_customer_id")
    assert rows(mapped, "customer_id") == [("c1", "c1"), ("c2", "c1"), ("c3", "c3")]


def test_clean_orders(frame):
    data = [
        (1, "delivered", "2020-01-12 01:00:00", "2020-01-10 00:00:00"),
        (2, "delivered", None, "2020-01-10 00:00:00"),
        (3, "shipped", None, "2020-01-10 00:00:00"),
    ]
    schema = (
        "order_id int, order_status string, order_delivered_customer_date string, "
        "order_estimated_delivery_date string"
    )
    got = clean.clean_orders(frame(data, schema)).select("order_id", "delivery_delay_days")
    assert rows(got, "order_id") == [(1, 2), (2, None)]
    assert clean.clean_orders(frame(data, schema), status=None).count() == 3


def test_malformed_timestamp_is_an_error(frame):
    df = frame([("not a date",)], "order_approved_at string")
    with pytest.raises(PySparkException):
        clean.parse_timestamps(df, ["order_approved_at"]).collect()


def test_payments(frame):
    data = [
        ("o1", 1, "card", 1, Decimal("10.00")),
        ("o1", 2, "voucher", 4, Decimal("5.00")),
        ("o1", 3, "card", 2, Decimal("1.00")),
        (None, 1, "card", 1, Decimal("9.00")),
        ("o2", 2, "card", 1, Decimal("0.10")),
        ("o2", 1, "voucher", 1, Decimal("0.20")),
    ]
    schema = (
        "order_id string, payment_sequential int, payment_type string, "
        "payment_installments int, payment_value decimal(18,2)"
    )
    for df in (frame(data, schema), frame(data[::-1], schema).repartition(4)):
        assert rows(clean.aggregate_payments(df), "order_id") == [
            ("o1", Decimal("16.00"), "card,voucher", 4),
            ("o2", Decimal("0.30"), "voucher,card", 1),
        ]


def test_items(frame):
    df = frame([(1, Decimal("1.10"), Decimal("0.25"))], "id int, price decimal(18,2), freight_value decimal(18,2)")
    assert clean.item_total_value(df).first()["total_value"] == Decimal("1.35")


def test_products_without_name_or_translation_are_unknown(frame):
    products = frame(
        [(1, "brinquedos", 3, 4, 5), (2, None, 3, 4, 5), (3, "outros", 3, 4, 5)],
        "product_id int, product_category_name string, product_name_lenght int, "
        "product_description_lenght int, product_photos_qty int",
    )
    names = frame([("brinquedos", "toys")], "product_category_name string, product_category_name_english string")
    got = clean.clean_products(products, names)
    assert set(got.columns) == {"product_id", "product_category_name", "product_category_name_english"}
    english = got.select("product_id", "product_category_name_english")
    assert rows(english, "product_id") == [(1, "toys"), (2, "unknown"), (3, "unknown")]


def test_reviews_one_per_order(frame):
    df = frame([("o1", 5, 2, "x"), ("o1", 1, 1, "y")], "order_id string, review_score int, n int, t string")
    assert rows(clean.clean_reviews(df, ["n"]), "order_id") == [("o1", 1)]


def test_drop_incomplete(frame):
    df = frame([(1, None, 2), (1, 2, None), (1, 2, 3)], "a int, b int, c int")
    assert clean.drop_incomplete(df).count() == 1
    assert clean.drop_incomplete(df, ["a", "b"]).count() == 2


def test_profile(frame):
    df = frame([(1, None), (None, None), (3, "x")], "a int, b string")
    assert rows(quality.profile_table(df), "column") == [("a", 3, 1), ("b", 3, 2)]
    whole = frame([(1,)], "a int")
    assert quality.null_columns(quality.profile_table(whole)).count() == 0


def test_constraints(frame):
    child = frame([(1,), (1,), (2,), (None,)], "k int")
    parent = frame([(2,)], "k int")
    assert rows(quality.check_unique(child.dropna(), ["k"]), "k") == [(1, 2)]
    assert rows(quality.check_foreign_key(child, parent, "k"), "k") == [(1, 2)]


def test_single_purchase_rate(frame):
    df = frame([(1,), (1,), (2,), (3,)], "frequency int")
    assert quality.single_purchase_rate(df).first()[0] == 50.0
