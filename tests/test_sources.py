from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillwise.session import materialize, scratch_path
from tillwise.sources import sinks
from tillwise.sources.raw import read_all_raw, read_raw
from tillwise.sources.csvblocks import read_quoted_csv
from tillwise.sources.star import (
    TABLES,
    Star,
    build_star,
    drop_old_versions,
    load_star,
    save_star_tables,
    write_star,
)

FILES = {
    "shop_customers_dataset.csv": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc2,u1,1,X,S\nc1,u1,2,Y,T\n",
    "shop_orders_dataset.csv": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
    "o1,c2,delivered,2020-01-01 10:00:00,,,2020-01-05 00:00:00,2020-01-04 23:00:00\n"
    "o2,c1,canceled,2020-01-01 10:00:00,,,,2020-01-04 23:00:00\n",
    "shop_order_items_dataset.csv": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\no1,1,p1,s1,2020-01-02 00:00:00,58.9,13.29\n",
    "shop_order_payments_dataset.csv": "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,2,voucher,1,2.19\no1,1,card,3,70\n",
    "shop_order_reviews_dataset.csv": 'review_id,order_id,review_score,review_comment_message\nr1,o1,4,"two\nlines, ""quoted"""\nr2,o1,1,\n',
    "shop_products_dataset.csv": "product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty\np1,brinquedos,1,2,3\n",
    "shop_sellers_dataset.csv": "seller_id,seller_city,seller_state\ns1,X,S\n",
    "shop_geolocation_dataset.csv": "zip,lat\n1,2\n",
    "product_category_name_translation.csv": "product_category_name,product_category_name_english\nbrinquedos,toys\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def star(spark, folder):
    return build_star(read_all_raw(spark, folder))


def test_raw_types_and_extra_columns(spark, folder):
    items = read_raw(spark, folder, "order_items")
    assert dict(items.dtypes)["price"] == "decimal(18,2)"
    assert dict(items.dtypes)["order_item_id"] == "string"
    assert items.first()["freight_value"] == Decimal("13.29")
    assert read_raw(spark, folder, "reviews").count() == 2
    assert read_raw(spark, folder, "geolocation").columns == ["zip", "lat"]


def test_csv_to_star(star):
    # the first row of the file stays, not the least id
    assert [r["customer_id"] for r in star.customers.collect()] == ["c2"]
    order = star.orders.first()
    assert star.orders.count() == 1 and order["delivery_delay_days"] == 0
    assert star.reviews.first()["review_score"] == 4 and star.reviews.count() == 1
    pay = star.payments.first()
    assert tuple(pay) == ("o1", Decimal("72.19"), "card,voucher", 3)
    assert star.products.first()["product_category_name_english"] == "toys"


def test_first_row_needs_an_order(spark, folder):
    raw = read_all_raw(spark, folder)
    star = build_star(raw | {"reviews": raw["reviews"].drop("row_order")})
    with pytest.raises(ValueError, match="reviews"):
        star.reviews  # noqa: B018


def test_store_and_load(spark, star, tmp_path):
    folder = str(tmp_path / "star")
    write_star(star, folder)
    write_star(star, folder)
    loaded = load_star(spark, folder)
    for name in TABLES:
        assert getattr(loaded, name).schema.simpleString() == getattr(star, name).schema.simpleString()
        assert getattr(loaded, name).count() == getattr(star, name).count()


def test_a_failing_write_leaves_the_old_star(spark, star, tmp_path):
    folder = str(tmp_path / "star")
    write_star(star, folder)
    tables = {name: getattr(star, name) for name in TABLES}
    broken = star.reviews.withColumn("review_score", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        write_star(Star(**tables | {"reviews": broken}), folder)
    assert load_star(spark, folder).reviews.count() == 1
    # a star written from itself, while a reader still holds the version before
    old = load_star(spark, folder)
    twice = Star(**{n: getattr(old, n).union(getattr(old, n)) for n in TABLES})
    write_star(twice, folder)
    assert (old.orders.count(), load_star(spark, folder).orders.count()) == (1, 2)
    assert drop_old_versions(spark, folder) == 2 and load_star(spark, folder).orders.count() == 2
    with pytest.raises(FileNotFoundError):
        load_star(spark, str(tmp_path / "none"))


REVIEWS = [
    ("plain", "1"),
    ("", "2"),
    ("two\nlines, and a comma", "3"),
    ('"quoted" at the start\n\n\nand blank lines', "4"),
    ('ends in a quote "', "5"),
    ("é" * 300 + "\n" + "long " * 200, "6"),
    ('"', "7"),
    ("\n", "8"),
]


@pytest.mark.parametrize("block, end", [(37, "\n"), (300, "\n"), (64 << 20, "\n"), (90, "\r\n")])
def test_quoted_breaks_in_many_blocks(spark, tmp_path, block, end):
    """Equal to the reader that takes each file whole, wherever the blocks are cut."""
    rows = [(f"{i}", *REVIEWS[(i * 5 + i // 8) % 8]) for i in range(60)]
    for part in (0, 1):
        quoted = ['"{}","{}",{}'.format(k, t.replace('"', '""'), s) for k, t, s in rows[part * 30 : part * 30 + 30]]
        text = "id,text,score\n" + "\n".join(quoted) + ("\n" if part else "")
        (tmp_path / f"part{part}.csv").write_bytes(text.replace("\n", end).encode())
    whole = spark.read.options(header=True, multiLine=True, escape='"', mode="FAILFAST").csv(str(tmp_path))
    want = [tuple(r) for r in whole.orderBy(F.col("id").cast("int")).collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_quoted_csv(spark, str(tmp_path))
        got = read.orderBy("row_order").drop("row_order").collect()
        assert [tuple(r) for r in got] == want and [r["id"] for r in got] == [str(i) for i in range(60)]
        tasks = read.select(F.spark_partition_id()).distinct().count()
        assert tasks > 20 or block > 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_rows_must_fit_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n1,2,3\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_quoted_csv(spark, str(tmp_path)).collect()


def test_bucketed_tables_join_without_shuffle(spark, star):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    save_star_tables(star, "shop", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("shop.fact_orders").join(spark.table("shop.fact_items"), "order_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE shop CASCADE")


def test_star_wants_all_tables(star):
    with pytest.raises(ValueError):
        Star(orders=star.orders)
    with pytest.raises(AttributeError):
        star.nothing


def test_materialize_cuts_the_plan(spark):
    df = spark.range(10).withColumnRenamed("id", "odd name")
    stored = materialize(df)
    assert stored.dtypes == df.dtypes and stored.count() == 10
    assert "Range" not in stored._jdf.queryExecution().logical().toString()
    assert scratch_path(spark) != scratch_path(spark)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "b"), (0, 1, "a2"), (0, 0, "a1")], "section int, seq int, line string")
    sinks.write_report(df.repartition(3), str(tmp_path / "report"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["a1", "a2", "b"]
    sinks.write_result(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == df.columns
    sinks.write_result(df, str(tmp_path / "pq"), "parquet")
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3


def test_model_sink(spark, tmp_path):
    from tillwise.ml.classify import logistic_regression, with_weights

    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (1, 1)], "review_score int, churned int")
    model = logistic_regression(["review_score"]).fit(with_weights(df))
    sinks.save_model(model, str(tmp_path / "model"))
    loaded = sinks.load_model(str(tmp_path / "model"))
    assert loaded.stages[0].getInputCols() == ["review_score"]
    assert loaded.transform(df).count() == 4
