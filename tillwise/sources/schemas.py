"""Columns of the raw tables that the operators use, with their types."""

from __future__ import annotations

MONEY = "decimal(18,2)"

_KEYS = {"order_id": "string", "customer_id": "string", "product_id": "string", "seller_id": "string"}


def _columns(*keys: str, **others: str) -> dict[str, str]:
    return {k: _KEYS[k] for k in keys} | others


RAW_SCHEMAS: dict[str, dict[str, str]] = {
    "customers": _columns(
        "customer_id",
        customer_unique_id="string",
        customer_city="string",
        customer_state="string",
    ),
    "orders": _columns(
        "order_id",
        "customer_id",
        order_status="string",
        order_purchase_timestamp="timestamp_ntz",
        order_approved_at="timestamp_ntz",
        order_delivered_carrier_date="timestamp_ntz",
        order_delivered_customer_date="timestamp_ntz",
        order_estimated_delivery_date="timestamp_ntz",
    ),
    "order_items": _columns(
        "order_id",
        "product_id",
        "seller_id",
        shipping_limit_date="timestamp_ntz",
        price=MONEY,
        freight_value=MONEY,
    ),
    "payments": _columns(
        "order_id",
        payment_sequential="int",
        payment_type="string",
        payment_installments="int",
        payment_value=MONEY,
    ),
    "reviews": _columns("order_id", review_score="int"),
    "products": _columns("product_id", product_category_name="string"),
    "sellers": _columns("seller_id", seller_city="string", seller_state="string"),
    "geolocation": {},
    "category": {
        "product_category_name": "string",
        "product_category_name_english": "string",
    },
}

# fixed values: file name endings of the nine raw tables
RAW_FILES = {
    "customers": "*customers_dataset.csv",
    "orders": "*orders_dataset.csv",
    "order_items": "*order_items_dataset.csv",
    "payments": "*order_payments_dataset.csv",
    "reviews": "*order_reviews_dataset.csv",
    "products": "*products_dataset.csv",
    "sellers": "*sellers_dataset.csv",
    "geolocation": "*geolocation_dataset.csv",
    "category": "product_category_name_translation.csv",
}
