"""Queries on tables where one customer, product, seller and order hold a third of the rows."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare, duck

SOURCE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SOURCE).exists(), reason="no test tables")

# Which row is hot depends on a hash, so the kinds of skew overlap.
SKEWED = {
    "orders": """SELECT o_orderkey, CASE WHEN hash(o_orderkey) % 3 = 0 THEN 7 ELSE o_custkey END
        AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM t""",
    "lineitem": """SELECT * REPLACE (
        CASE WHEN hash(l_orderkey, l_extendedprice) % 3 = 0
            THEN (SELECT min(o_orderkey) FROM '{source}/orders.parquet' WHERE o_orderstatus = 'F')
            ELSE l_orderkey END AS l_orderkey,
        CASE WHEN hash(l_extendedprice) % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey,
        CASE WHEN hash(l_extendedprice, 5) % 3 = 0 THEN 3 ELSE l_suppkey END AS l_suppkey) FROM t""",
    "part": "SELECT * REPLACE (CASE WHEN hash(p_partkey) % 3 = 0 THEN 'PROMO' ELSE p_type END AS p_type) FROM t",
}

NAMES = [
    "aggregate_payments",
    "check_foreign_key",
    "churn_features",
    "clean_customers",
    "cohort_retention",
    "insight_report",
    "orphan_orders",
    "review_churn",
    "rfm_summary",
    "roc_curve",
    "stratified_split",
    "top_categories",
    "v_category_performance_per_order",
    "v_churn_risk",
    "v_monthly_revenue",
    "v_seller_risk",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("skew")
    con = duckdb.connect()
    for t in TABLES:
        sql = SKEWED.get(t, "SELECT * FROM t").format(source=SOURCE)
        sql = sql.replace("FROM t", f"FROM '{SOURCE}/{t}.parquet'") if sql.endswith("FROM t") else sql
        con.execute(f"COPY ({sql}) TO '{root}/{t}.parquet' (FORMAT parquet)")
    return str(root)


@pytest.fixture(scope="module", params=["broadcast", "shuffle"])
def joins(spark, request):
    """Once as planned, once with every join shuffled."""
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, folder, joins, name):
    con = duck(folder)
    sql = entry.oracle_sql()[name]
    assert compare(spark, con, name, entry.queries()[name], sql, folder) is None


def test_the_tables_are_skewed(folder):
    con = duck(folder)
    for table, col in [("orders", "o_custkey"), ("lineitem", "l_partkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_suppkey")]:
        n, top = con.execute(
            f"SELECT sum(c), max(c) FROM (SELECT count(*) AS c FROM {table} GROUP BY {col})"
        ).fetchone()
        assert top / n > 0.3
