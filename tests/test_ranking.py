import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tillwise.operators.ranking import first_per_key, ntile_distributed, running_totals, top_k
from tillwise.operators.skew import hot_keys, measured_salts, spread_join, vocabulary_join


def tiles(df, k, column, descending=False):
    keys = {"t": (F.col(column), descending)}
    out = ntile_distributed(df, k, keys, "id")
    return {r["id"]: r["t"] for r in out.collect()}


def native(df, k, column, descending=False):
    first = F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
    out = df.withColumn("t", F.ntile(k).over(W.orderBy(first, "id")))
    return {r["id"]: r["t"] for r in out.collect()}


@pytest.mark.parametrize("n", [0, 1, 3, 5, 6, 7, 8, 9, 500])
def test_ntile_sizes(spark, n):
    rng = random.Random(n)
    rows = [(f"c{i:04d}", rng.randrange(4)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, v int").repartition(5)
    assert tiles(df, 5, "v") == native(df, 5, "v")


@pytest.mark.parametrize("descending", [False, True])
def test_ntile_with_nulls_and_all_ties(spark, descending):
    rows = [(i, None if i % 7 == 0 else (1 if i % 3 else 10**12)) for i in range(203)]
    df = spark.createDataFrame(rows, "id bigint, v bigint").repartition(6)
    assert tiles(df, 5, "v", descending) == native(df, 5, "v", descending)
    same = df.withColumn("v", F.lit(1))
    assert tiles(same, 4, "v", descending) == native(same, 4, "v", descending)


def test_several_tilings_at_once(spark):
    df = spark.range(1000).select(
        F.col("id"), (F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 10).alias("b")
    )
    out = ntile_distributed(df, 5, {"x": (F.col("a"), False), "y": (F.col("b"), True)}, "id")
    got = {r["id"]: (r["x"], r["y"]) for r in out.collect()}
    x, y = native(df, 5, "a"), native(df, 5, "b", True)
    assert got == {i: (x[i], y[i]) for i in x}


def test_ntile_rows_never_meet_in_one_task(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 3)
    out = ntile_distributed(df, 5, {"t": (F.col("v"), False)}, "id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("n", [1, 2, 300])
def test_running_totals(spark, n):
    rows = [(float(i * 37 % 1009), i % 5, i % 3) for i in range(n)]
    df = spark.createDataFrame(rows, "s double, p bigint, q bigint").repartition(4)
    got = {r["s"]: (r["cum_p"], r["cum_q"]) for r in running_totals(df, "s", ["p", "q"]).collect()}
    p = q = 0
    for s, a, b in sorted(rows):
        p, q = p + a, q + b
        assert got[s] == (p, q)


def test_first_per_key_and_top_k(spark):
    df = spark.createDataFrame([("a", 2, 20), ("a", 1, 10), ("b", 5, 50)], "k string, o int, v int")
    got = {tuple(r) for r in first_per_key(df, ["k"], ["o"]).collect()}
    assert got == {("a", 1, 10), ("b", 5, 50)}
    ranked = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, 1.0)], "id int, v double")
    assert [r["id"] for r in top_k(ranked, "v", 3, ["id"]).collect()] == [2, 1, 3]


def test_hot_keys_finds_the_large_share(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert hot_keys(df, "k") == [7]
    assert hot_keys(spark.range(5000), "id") == []
    assert hot_keys(spark.range(0), "id") == []


@pytest.mark.parametrize("tasks", [4, 200, 2000])
def test_hot_keys_get_as_many_tasks_as_their_share_fills(spark, tasks):
    """The fullest (key, salt) holds about rows / tasks, whatever the number of tasks."""
    n = 60_000
    third, tenth = F.col("id") % 3 == 0, F.col("id") % 10 == 1
    fact = spark.range(n).select(
        F.col("id").alias("row"), F.when(third, 7).when(tenth, 9).otherwise(F.col("id") + 100).alias("k")
    )
    salts = {r["k"]: r["n_salts"] for r in measured_salts(fact, "k", tasks).collect()}
    assert salts[7] == -(-tasks // 3) and set(salts) <= {7, 9}
    dim = fact.select("k").distinct().withColumn("d", F.col("k") * 2)
    joined = spread_join(fact, dim, "k", ["row"], tasks=tasks)
    assert joined.filter("d = 2 * k").count() == n
    spread = F.pmod(F.xxhash64("row"), F.lit(salts[7]))
    fullest = fact.filter("k = 7").groupBy(spread).count().agg(F.max("count")).first()[0]
    assert fullest <= 2 * n / tasks + 30


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, how):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.range(3000).select(
            F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 900).alias("k")
        )
        dim = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))
        spread = spread_join(fact, dim, "k", ["row"], how)
        plain = fact.join(dim, "k", how)
        assert "_salt" in spread._jdf.queryExecution().toString()
        assert spread.columns == plain.columns
        assert sorted(map(tuple, spread.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_spread_join_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fact = spark.range(4000).select(F.col("id").alias("row"), F.lit(1).alias("k"))
        dim = spark.createDataFrame([(1, "x")], "k int, d string")
        joined = spread_join(fact, dim, "k", ["row"])
        per_task = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) > 1 and sum(r["count"] for r in per_task) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_vocabulary_join_spreads_every_key_and_the_missing_one(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fact = spark.range(900).select(
            F.col("id").alias("row"), F.when(F.col("id") % 3 == 1, "a").when(F.col("id") % 3 == 2, "b").alias("k")
        )
        names = spark.createDataFrame([("a", "A")], "k string, english string")
        joined = vocabulary_join(fact, names, "k", ["row"])
        assert joined.count() == 900 and joined.filter("english = 'A'").count() == 300
        per_task = joined.filter("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert len(per_task) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
