import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tillwise.ml import classify, cluster, forecast, metrics
from tillwise.operators.features import FEATURES, stratified_split


@pytest.fixture(scope="module")
def customers(spark):
    """Customers with a planted signal: dear freight goes with churn."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x = [round(rng.random() * 10, 2) for _ in FEATURES]
        ratio = x[FEATURES.index("avg_freight_ratio")]
        rows.append((f"c{i}", *x, int(ratio + rng.gauss(0, 2) > 5)))
    schema = ", ".join(["customer_unique_id string", *[f"{f} double" for f in FEATURES], "churned int"])
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def parts(customers):
    rows = stratified_split(customers, "customer_unique_id").cache()
    return rows.filter("not is_test"), rows.filter("is_test")


def test_leaking_inputs_are_refused():
    assert "recency_days" not in FEATURES and len(FEATURES) == 11
    with pytest.raises(ValueError):
        classify.random_forest([*FEATURES, "recency_days"])


def brute_auc(rows):
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [1, 3, 1000])
def test_metrics_against_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = []
    for _ in range(300):
        y = int(rng.random() < 0.4)
        rows.append((y, math.floor((rng.random() + 0.3 * y) * levels) / levels))
    data = [(y, s, int(s > 0.6)) for y, s in rows]
    df = spark.createDataFrame(data, "label int, score double, prediction int").repartition(4)
    got = metrics.classification_metrics(df).first()
    assert abs(got["AUC-ROC"] - brute_auc(rows)) <= 0.00005 + 1e-12
    tp = sum(y and p for y, _, p in data)
    assert got["Recall"] == round(tp / sum(y for y, *_ in data) + 1e-12, 4)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert abs(got["AUC-ROC"] - evaluator.evaluate(df)) < 1e-4
    curve = metrics.roc_curve(df, "label", "score").orderBy(F.col("threshold").desc()).collect()
    assert len(curve) == len({s for _, s in rows}) + 1
    assert (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)
    assert tuple(curve[0]) == (math.inf, 0.0, 0.0)
    top = curve[1]
    assert top["tpr"] == sum(y and s >= top["threshold"] for y, s in rows) / sum(y for y, _ in rows)


def test_area_by_keys_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b"]), rng.choice([None, 1]), int(rng.random() < 0.4), rng.randint(0, 6) / 7) for _ in range(400)]
    df = spark.createDataFrame(rows, "m string, d int, y int, s double").repartition(5)
    got = {(r["m"], r["d"]): r["auc"] for r in metrics.auc_by(df, ["m", "d"], "y", "s", None).collect()}
    for key in [(m, d) for m in "ab" for d in (None, 1)]:
        assert abs(got[key] - brute_auc([(y, s) for m, d, y, s in rows if (m, d) == key])) < 1e-12
    with_said = df.withColumn("p", (F.col("s") > 0.5).cast("int"))
    by = metrics.classification_metrics_by(with_said, ["m"], "y", "s", "p").filter("m = 'a'").drop("m").first()
    assert by == metrics.classification_metrics(with_said.filter("m = 'a'"), "y", "s", "p").first()


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5, 0)], "label int, score double, prediction int")
    got = metrics.classification_metrics(df).first()
    assert got["AUC-ROC"] is None and got["Precision"] == 0.0


def test_benchmark_champion_and_tuning(parts):
    train, test = parts
    models = classify.default_models(trees=5, depth=4, rounds=3)
    ranking = classify.benchmark_models(train, test, models).cache()
    aucs = [r["AUC-ROC"] for r in ranking.collect()]
    assert len(aucs) == 4 and aucs == sorted(aucs, reverse=True) and aucs[0] > 0.8
    assert classify.champion(ranking).first()["AUC-ROC"] == aucs[0]
    folds = classify.with_folds(classify.with_weights(train), "customer_unique_id", 2).cache()
    grid = {"trees": [3], "max_depth": [2, None], "min_split": [2], "min_leaf": [1]}
    result, best = classify.grid_search(folds, grid, folds=2)
    assert result.count() == 2 and result.first()["mean_auc"] > 0.7
    gain = classify.tuned_gain(best, train, test, ranking).first()
    assert abs(gain["gain"] - (gain["tuned_auc"] - aucs[0])) < 1e-3
    cv = {r["model"]: r for r in classify.cross_validate(folds, models, folds=2).collect()}
    assert len(cv) == 4 and all(r["mean_auc"] > 0.7 and r["std_auc"] >= 0 for r in cv.values())


def test_balanced_weights(parts):
    train, _ = parts
    got = classify.with_weights(train).groupBy("churned").agg(F.sum(classify.WEIGHT).alias("w")).collect()
    assert abs(got[0]["w"] - got[1]["w"]) < 1e-6


def test_score_only(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 5), rng.randint(0, 1)) for i in range(300)]
    df = stratified_split(spark.createDataFrame(rows, "order_id int, review_score int, churned int"), "order_id")
    got = classify.score_only_model(df.filter("not is_test"), df.filter("is_test"), full_auc=0.9).first()
    assert 0.3 < got["score_only_auc"] < 0.7
    assert abs(got["full_gain"] - (0.9 - got["score_only_auc"])) < 1e-9


def test_clusters(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        r, f, m = [(10, 5, 900.0), (200, 1, 50.0), (400, 2, 400.0)][i % 3]
        rows.append((i, r + rng.randint(0, 5), f, m + rng.randint(0, 5)))
    df = spark.createDataFrame(rows, "customer_unique_id int, recency_days int, frequency int, monetary double")
    scan = cluster.kmeans_scan(df, ks=range(2, 5), starts=3)
    assert cluster.best_k(scan) == 3
    inertia = [r["inertia"] for r in scan.orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True)
    assigned = cluster.kmeans_assign(df, 3, starts=3)
    profile = cluster.cluster_label(cluster.cluster_profile(assigned)).collect()
    assert sorted(r["customer_count"] for r in profile) == [100, 100, 100]
    assert {r["label"] for r in profile} == {"High Value Active", "Churned Low Value", "Lapsed High Value"}


def test_standardize(spark):
    df = spark.createDataFrame([(1, 7), (3, 7)], "a int, b int")
    got = cluster.standardize(df, ["a", "b"]).orderBy("a").collect()
    assert [(r["z_a"], r["z_b"]) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_forecast_finds_trend_and_season(spark):
    start, rows = dt.date(2015, 1, 5), []
    for key, level in (("a", 1000.0), ("b", 50.0)):
        for w in range(208):
            day = w * 7
            wave = 1 + 0.3 * math.sin(2 * math.pi * day / 365.25)
            rows.append((key, start + dt.timedelta(days=day), level * (1 + day / 2000) * wave))
    series = spark.createDataFrame(rows, "k string, ds date, y double")
    out = forecast.forecast_revenue(series, ["k"]).collect()
    last = start + dt.timedelta(days=207 * 7)
    future = [r for r in out if r["ds"] > last]
    assert len(out) == 2 * (208 + 13) and len(future) == 26
    for r in future:
        day = (r["ds"] - start).days
        level = 1000.0 if r["k"] == "a" else 50.0
        truth = level * (1 + day / 2000) * (1 + 0.3 * math.sin(2 * math.pi * day / 365.25))
        assert abs(r["yhat"] / truth - 1) < 0.1
        assert r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"]
    daily = forecast.forecast_revenue(series.filter("k = 'a'").drop("k"), step_days=1)
    assert daily.count() == 208 + 90


def test_forecast_keeps_its_season_below_two_years(spark):
    start, rows = dt.date(2015, 1, 5), []
    for w in range(96):
        level = 1000.0 * (1 + 0.3 * math.sin(2 * math.pi * w * 7 / 365.25))
        rows.append((start + dt.timedelta(days=w * 7), level))
    out = forecast.forecast_revenue(spark.createDataFrame(rows, "ds date, y double")).collect()
    for r in out:
        truth = 1000.0 * (1 + 0.3 * math.sin(2 * math.pi * (r["ds"] - start).days / 365.25))
        assert abs(r["yhat"] / truth - 1) < 0.05


def test_forecast_interval_widens_with_a_bending_trend(spark):
    start = dt.date(2015, 1, 5)
    rows = [(start + dt.timedelta(days=w * 7), 1000.0 + 400 * abs(w % 80 - 40)) for w in range(208)]
    out = forecast.forecast_revenue(spark.createDataFrame(rows, "ds date, y double")).orderBy("ds").collect()
    widths = [r["yhat_upper"] - r["yhat_lower"] for r in out[207:]]
    assert sum(widths[-4:]) > 1.05 * sum(widths[1:5])


def test_forecast_of_a_short_series(spark):
    rows = [(dt.date(2020, 1, 6), 5.0), (dt.date(2020, 1, 13), 0.0)]
    out = forecast.forecast_revenue(spark.createDataFrame(rows, "ds date, y double"), horizon_days=7)
    assert out.count() == 3


def test_forecast_summary_has_no_holes(spark):
    rows = [(dt.date(2020, 1, 6), 10.0), (dt.date(2020, 1, 12), 5.0), (dt.date(2020, 1, 27), 30.0)]
    df = spark.createDataFrame(rows, "ds date, yhat double")
    got = forecast.forecast_summary(df, "2020-01-01").first()
    assert (got["total"], got["avg_week"]) == (45.0, 11.25)
    assert (str(got["peak_week"]), str(got["low_week"])) == ("2020-02-02", "2020-01-19")


def test_weekly_revenue(spark):
    orders = spark.createDataFrame(
        [(1, 1, dt.datetime(2020, 1, 5)), (2, 1, dt.datetime(2020, 1, 6))],
        "order_id int, customer_id int, order_purchase_timestamp timestamp_ntz",
    )
    pay = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "order_id int, total_payment int, installments int")
    got = {str(r["ds"]): r["y"] for r in forecast.weekly_revenue(orders, pay).collect()}
    assert got == {"2019-12-30": 10.0, "2020-01-06": 20.0}
    keys = spark.createDataFrame([(1, "x"), (2, "y")], "order_id int, state string")
    assert forecast.weekly_revenue(orders, pay, keys).columns == ["state", "ds", "y"]


def fitted(y, n, bends, horizon=13):
    ds = pd.Series(pd.date_range("2015-01-05", periods=n, freq="7D"))
    future = pd.date_range(ds.iloc[-1], periods=horizon + 1, freq="7D")[1:]
    return forecast._fit_one(ds, y[:n], future, 0.95, {365.25: 3}, True, bends)


def test_a_kink_is_found_at_its_week():
    rng = np.random.default_rng(1)
    week = np.arange(208)
    y = 1000 + 4 * np.minimum(week, 90) - 6 * np.maximum(week - 90, 0) + rng.normal(0, 4, 208)
    days = week * 7.0
    places = forecast.bend_places(days[-1], 165)
    t = forecast._trend(days, days[-1], 165)
    target = y / y.mean()
    noise = np.diff(target).var() / 2
    _, bend = forecast.sparse_fit(t[:, :2], np.full(2, 1e-9), t[:, 2:], target, noise / 0.05, np.zeros(165))
    sharp = np.abs(bend) > 0.1 * np.abs(bend).max()
    assert sharp.sum() <= 6 and (np.abs(places[sharp] / 7 - 90) <= 3).all()
    assert (bend != 0).sum() < 40


def test_sparse_fit_meets_its_conditions():
    """At the optimum the residual pulls a used column by the penalty and an unused one by less."""
    rng = np.random.default_rng(2)
    free, sparse = rng.normal(size=(80, 3)), rng.normal(size=(80, 12))
    y = free @ [1.0, 2.0, 3.0] + sparse[:, 4] * 2 + rng.normal(0, 0.1, 80)
    coef, beta = forecast.sparse_fit(free, np.full(3, 1e-9), sparse, y, 5.0, np.zeros(12))
    pull = sparse.T @ (y - free @ coef - sparse @ beta)
    assert np.allclose(pull[beta != 0], 5.0 * np.sign(beta[beta != 0]), atol=1e-2)
    assert (np.abs(pull[beta == 0]) <= 5.0 + 1e-2).all() and beta[4] > 1.5


@pytest.mark.parametrize("scale", [0.0, 0.08])
def test_interval_covers_planted_futures(scale):
    rng = np.random.default_rng(5)
    n, every, inside = 208, 221, []
    for _ in range(40):
        bends = rng.random(every) < 25 / 0.8 / (n - 1)
        turns = np.where(bends, rng.laplace(0, scale, every) if scale else 0.0, 0) / (n - 1)
        slope = np.cumsum(turns) + 0.3 / (n - 1)
        line = 1 + np.concatenate([[0], np.cumsum(slope)[:-1]])
        wave = 1 + 0.1 * np.sin(2 * np.pi * np.arange(every) * 7 / 365.25)
        y = (line * wave + rng.normal(0, 0.05, every)) * 1000
        out = fitted(y, n, 25)
        low, high = out["yhat_lower"].to_numpy()[n:], out["yhat_upper"].to_numpy()[n:]
        inside.append(((y[n:] >= low) & (y[n:] <= high)).mean())
    assert 0.88 <= np.mean(inside) <= 0.98
