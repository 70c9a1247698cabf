"""The star schema: building it from raw tables, storing, loading and publishing it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tillwise.operators import clean
from tillwise.params import DEFAULTS

# fixed values: stored names of the tables
TABLES = {
    "customers": "dim_customers",
    "products": "dim_products",
    "sellers": "dim_sellers",
    "orders": "fact_orders",
    "items": "fact_items",
    "payments": "fact_payments",
    "reviews": "fact_reviews",
}


class Star:
    """Three dimensions and four facts, as attributes named like the keys of ``TABLES``.

    customer_id, product_id, seller_id and orders.order_id are unique, payments
    and reviews have one row per order (``operators.quality`` checks this).  A
    table may be given as a function; its plan is then built on first use.
    """

    customers: DataFrame
    products: DataFrame
    sellers: DataFrame
    orders: DataFrame
    items: DataFrame
    payments: DataFrame
    reviews: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if set(tables) != set(TABLES):
            raise ValueError(f"needs exactly the tables {sorted(TABLES)}")
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = table()
        setattr(self, name, table)
        return table


def build_star(
    raw: Mapping[str, DataFrame],
    status: str | None = DEFAULTS.delivered_status,
    customer_order: list[str] | None = None,
    review_order: list[str] | None = None,
    payment_seq: str = "payment_sequential",
) -> Star:
    """Cleaned tables; the ``*_order`` columns say which of several rows came first.

    Without them customers and reviews must carry ``row_order``, as ``read_all_raw`` gives it.
    """

    def first_by(table: str, given: list[str] | None) -> list[str]:
        if given is None and "row_order" not in raw[table].columns:
            raise ValueError(f"{table}: name the order columns, or read it with its row_order")
        return given or ["row_order"]

    return Star(
        customers=lambda: clean.clean_customers(
            raw["customers"], first_by("customers", customer_order)
        ).drop("row_order"),
        products=lambda: clean.clean_products(raw["products"], raw["category"]),
        sellers=lambda: clean.clean_sellers(raw["sellers"]),
        orders=lambda: clean.clean_orders(raw["orders"], status),
        items=lambda: clean.clean_items(raw["order_items"]),
        payments=lambda: clean.aggregate_payments(raw["payments"], payment_seq),
        reviews=lambda: clean.clean_reviews(raw["reviews"], first_by("reviews", review_order)),
    )


def write_star(star: Star, folder: str) -> None:
    """A new version of the star as Parquet tables; readers see the old one until all tables are there.

    Tables go to a folder of their own.  What makes them the star is a small numbered file, put in
    place by one rename that fails if another writer took the number.  So a star can be written from
    the one it replaces, and a write that fails leaves that one whole.
    """
    spark = star.orders.sparkSession
    root, before = folder.rstrip("/"), _current(spark, folder)
    version = f"versions/{uuid.uuid4().hex}"
    for name, stored in TABLES.items():
        getattr(star, name).write.parquet(f"{root}/{version}/{stored}")
    fs, path = _files(spark, root)
    number = before[0] + 1 if before else 1
    draft, final = path(f"{root}/{version}/manifest"), path(f"{root}/{MANIFESTS}/{number:012d}")
    fs.mkdirs(final.getParent())
    out = fs.create(draft)
    out.write(bytearray(version, "utf-8"))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"another writer replaced the star in {folder}; its version {number} stays")


MANIFESTS = "manifests"


def _files(spark: SparkSession, root: str):
    """The Hadoop file system of a folder, and its path constructor."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _current(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """Number and folder of the current version."""
    root = folder.rstrip("/")
    fs, path = _files(spark, root)
    if not fs.exists(path(f"{root}/{MANIFESTS}")):
        return None
    numbers = [s.getPath().getName() for s in fs.listStatus(path(f"{root}/{MANIFESTS}"))]
    numbers = sorted(n for n in numbers if n.isdigit())
    if not numbers:
        return None
    return int(numbers[-1]), spark.read.text(f"{root}/{MANIFESTS}/{numbers[-1]}").first()[0]


def load_star(spark: SparkSession, folder: str) -> Star:
    """The current version of a stored star; its tables stay the same when a newer one is written."""
    current = _current(spark, folder)
    if current is None:
        raise FileNotFoundError(f"no star in {folder}")
    root = f"{folder.rstrip('/')}/{current[1]}"
    return Star(**{name: spark.read.parquet(f"{root}/{stored}") for name, stored in TABLES.items()})


def drop_old_versions(spark: SparkSession, folder: str) -> int:
    """Deletes the tables of all versions but the current one; returns how many went.

    Not to be run while another reader or writer uses them.
    """
    root, current = folder.rstrip("/"), _current(spark, folder)
    fs, path = _files(spark, root)
    old = [s.getPath() for s in fs.listStatus(path(f"{root}/versions"))] if current else []
    old = [p for p in old if p.getName() != current[1].split("/")[-1]]
    for p in old:
        fs.delete(p, True)
    return len(old)


def save_star_tables(star: Star, database: str | None = None, buckets: int | None = None) -> None:
    """Star as catalog tables.

    With ``buckets`` the order-keyed facts are bucketed and sorted by order_id,
    so that their joins on it need no shuffle.
    """
    for name, stored in TABLES.items():
        writer = getattr(star, name).write.mode("overwrite").format("parquet")
        if buckets and name in ("orders", "items", "payments", "reviews"):
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(f"{database}.{stored}" if database else stored)


def publish_jdbc(star: Star, url: str, properties: dict[str, str]) -> None:
    """Star to a relational database, replacing its tables."""
    for name, stored in TABLES.items():
        getattr(star, name).write.mode("overwrite").jdbc(url, stored, properties=properties)
