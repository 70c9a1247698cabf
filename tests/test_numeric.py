from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.functions import amount, cents, month_start, ratio_round, whole_days
from tillwise.functions.numeric import pearson


def test_ratio_round_half_away_from_zero(frame):
    rows = [(2345, 1000, 2.35), (-2345, 1000, -2.35), (1, 3, 0.33), (0, 5, 0.0), (7, 0, None)]
    df = frame(rows, "n bigint, d bigint, want double")
    got = df.select(ratio_round(F.col("n"), F.col("d"), 2).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**17), 10**17), st.integers(1, 10**9)), min_size=1, max_size=20))
def test_ratio_round_equals_exact_arithmetic(spark, pairs):
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = [r[0] for r in df.select(ratio_round(F.col("n"), F.col("d"), 1)).collect()]
    for (n, d), g in zip(pairs, got):
        units = (2 * abs(n) * 10 + d) // (2 * d)
        assert g == (units if n >= 0 else -units) / 10.0


def test_cents_of_decimal_and_double(frame):
    df = frame([(Decimal("19.99"), 19.99), (None, None)], "a decimal(18,2), b double")
    got = df.select(cents("a").alias("a"), cents("b").alias("b")).collect()
    assert got[0] == (1999, 1999) and got[1] == (None, None)
    back = df.select(amount(cents("a"))).first()[0]
    assert back == Decimal("19.99")


def test_whole_days_floors(spark):
    df = spark.sql(
        """SELECT timestamp_ntz'2020-10-10 01:00:00' a, timestamp_ntz'2020-10-09 23:00:00' b
        UNION ALL SELECT timestamp_ntz'2020-10-09 12:00:00', timestamp_ntz'2020-10-10 00:00:00'
        UNION ALL SELECT NULL, timestamp_ntz'2020-10-10 00:00:00'"""
    )
    got = [r[0] for r in df.select(whole_days(F.col("a"), F.col("b"))).collect()]
    assert got == [0, -1, None]


def test_whole_days_ignores_session_time_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 24 hours on the clock across the start of daylight saving
        df = spark.sql(
            "SELECT timestamp_ntz'2020-03-08 12:00:00' a, timestamp_ntz'2020-03-07 12:00:00' b"
        )
        assert df.select(whole_days(F.col("a"), F.col("b"))).first()[0] == 1
        assert str(df.select(month_start("a")).first()[0]) == "2020-03-01"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_pearson_of_a_constant_is_null(frame):
    df = frame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(pearson(F.col("x"), F.col("y"))).first()[0] is None
    assert abs(df.agg(pearson(F.col("y"), F.col("y"))).first()[0] - 1) < 1e-12
