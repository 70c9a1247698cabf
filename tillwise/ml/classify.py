"""Churn models: benchmark, cross validation, tuning."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.ml import boost, forest
from tillwise.ml.metrics import auc, auc_by, classification_metrics_by
from tillwise.ml.trees import Rule, bin_edges, binned_rows
from tillwise.operators.features import FEATURES, LABEL
from tillwise.params import DEFAULTS
from tillwise.session import materialize

WEIGHT = "class_weight"
BOOST_WEIGHT = "boost_weight"

# fixed values: columns that define the label and so must not be inputs
LEAKING = {"recency_days", LABEL}


def check_inputs(features: list[str]) -> list[str]:
    leaking = LEAKING.intersection(features)
    if leaking:
        raise ValueError(f"inputs that give the label away: {sorted(leaking)}")
    return features


def with_weights(df: DataFrame, label: str = LABEL, positive_weight: float = 0.7) -> DataFrame:
    """Adds balanced class weights n / (2 * n_class) and the weight of the boosted model."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    balanced = F.lit(1.0)
    for value, n in counts.items():
        balanced = F.when(F.col(label) == value, F.lit(total / (2.0 * n))).otherwise(balanced)
    boost_weight = F.when(F.col(label) == 1, F.lit(positive_weight)).otherwise(F.lit(1.0))
    return df.withColumns({WEIGHT: balanced, BOOST_WEIGHT: boost_weight})


@dataclass(frozen=True)
class Logistic:
    features: list[str]
    scaled: bool = True

    def pipeline(self) -> Pipeline:
        stages = [VectorAssembler(inputCols=self.features, outputCol="inputs")]
        if self.scaled:
            stages.append(
                StandardScaler(inputCol="inputs", outputCol="scaled", withMean=True, withStd=True)
            )
        model = LogisticRegression(labelCol=LABEL, weightCol=WEIGHT, regParam=0.0, maxIter=100)
        return Pipeline(stages=[*stages, model.setFeaturesCol("scaled" if self.scaled else "inputs")])

    def fit(self, train: DataFrame) -> PipelineModel:
        return self.pipeline().fit(train)

    def held_out(self, rows: DataFrame, folds: list[int], id_col: str) -> DataFrame:
        """(fold, label, score) of each fold's rows by a fit on all others."""
        found = []
        for fold in folds:
            model = self.fit(rows.filter(F.col("fold") != fold))
            scored = model.transform(rows.filter(F.col("fold") == fold))
            found.append(
                scored.select("fold", F.col(LABEL).alias("label"), vector_to_array("probability")[1].alias("score"))
            )
        return reduce(DataFrame.unionByName, found)


@dataclass(frozen=True)
class RandomForest:
    features: list[str]
    trees: int = 100
    rule: Rule | None = None
    weight: str | None = WEIGHT

    def held_out(self, rows: DataFrame, folds: list[int], id_col: str) -> DataFrame:
        cut = _binned(rows, self.features, folds, id_col, self.weight)
        fits = [(f, self.rule or forest.rule_of(len(self.features))) for f in folds]
        found = forest.held_out_scores(cut, len(self.features), fits, [forest.Stop()], [self.trees])
        fold = F.get(F.array(*[F.lit(f) for f in folds]), F.col("fit"))
        return found.select(fold.alias("fold"), "label", "score")


@dataclass(frozen=True)
class BoostedTrees:
    features: list[str]
    how: boost.Boosting = boost.SECOND_ORDER
    weight: str | None = None

    def held_out(self, rows: DataFrame, folds: list[int], id_col: str) -> DataFrame:
        cut = _binned(rows, self.features, folds, id_col, self.weight)
        return boost.boost(cut, len(self.features), folds, self.how).held_out().drop("row")


Model = Logistic | RandomForest | BoostedTrees


def _binned(rows: DataFrame, features: list[str], folds: list[int], id_col: str, weight: str | None) -> DataFrame:
    """Binned rows, cut at quantiles of the learning rows where only one fold is held out."""
    seen = rows.filter(F.col("fold") != folds[0]) if len(folds) == 1 else rows
    return materialize(binned_rows(rows, features, bin_edges(seen, features), id_col, LABEL, weight, "fold"))


def logistic_regression(features: list[str] = FEATURES, scaled: bool = True) -> Logistic:
    return Logistic(check_inputs(features), scaled)


def random_forest(
    features: list[str] = FEATURES,
    trees: int = 100,
    depth: int | None = None,
    min_split: int = 2,
    min_leaf: int = 1,
    balanced: bool = True,
) -> RandomForest:
    """Trees of any depth, unless ``depth`` ends them."""
    rule = forest.rule_of(len(check_inputs(features)), min_leaf, depth, min_split)
    return RandomForest(features, trees, rule, WEIGHT if balanced else None)


def gradient_boosting(features: list[str] = FEATURES, rounds: int = 100) -> BoostedTrees:
    how = boost.Boosting(rounds, boost.GRADIENT.depth, boost.GRADIENT.rate, second_order=False)
    return BoostedTrees(check_inputs(features), how)


def boosted_weighted(features: list[str] = FEATURES, rounds: int = 100) -> BoostedTrees:
    """Deeper, faster-learning second-order boosting with positives weighted 0.7."""
    return BoostedTrees(check_inputs(features), boost.Boosting(rounds), BOOST_WEIGHT)


def default_models(
    features: list[str] = FEATURES, trees: int = 100, depth: int | None = None, rounds: int = 100
) -> dict[str, Model]:
    return {
        "Logistic Regression": logistic_regression(features),
        "Random Forest": random_forest(features, trees, depth),
        "Gradient Boosting": gradient_boosting(features, rounds),
        "Weighted Boosting": boosted_weighted(features, rounds),
    }


def stacked_scores(
    rows: DataFrame, models: dict[str, Model], folds: list[int], id_col: str
) -> DataFrame:
    """(model, fold, label, score, prediction) of every held-out row, all models in one stored table.

    ``rows`` has ``fold`` and the weights; each model learns from the rows outside of a fold.
    """
    found = [
        m.held_out(rows, folds, id_col).select(F.lit(name).alias("model"), "fold", "label", "score")
        for name, m in models.items()
    ]
    stacked = reduce(DataFrame.unionByName, found)
    return materialize(stacked.withColumn("prediction", (F.col("score") > 0.5).cast("int")))


def test_scores(
    train: DataFrame, test: DataFrame, models: dict[str, Model], id_col: str
) -> DataFrame:
    """Stacked scores of the test rows; class weights come from the train rows."""
    learnt = with_weights(train).withColumn("fold", F.lit(1))
    held = test.withColumns({WEIGHT: F.lit(1.0), BOOST_WEIGHT: F.lit(1.0), "fold": F.lit(0)})
    return stacked_scores(materialize(learnt.unionByName(held)), models, [0], id_col)


def rank_models(stacked: DataFrame) -> DataFrame:
    """One row per model with its hold-out metrics, best AUC first."""
    found = classification_metrics_by(stacked, ["model"]).withColumnRenamed("model", "Model")
    return found.orderBy(F.col("AUC-ROC").desc(), "Model")


def benchmark_models(
    train: DataFrame, test: DataFrame, models: dict[str, Model] | None = None, id_col: str = "customer_unique_id"
) -> DataFrame:
    """Fits every model on ``train`` and ranks them on ``test``."""
    return rank_models(test_scores(train, test, models or default_models(), id_col))


def champion(ranking: DataFrame) -> DataFrame:
    """The row of the best model."""
    return ranking.orderBy(F.col("AUC-ROC").desc(), "Model").limit(1)


def with_folds(
    df: DataFrame, id_col: str, folds: int = DEFAULTS.cv_folds, seed: int = DEFAULTS.seed
) -> DataFrame:
    """Adds a fold number per row from a hash of its id: no shuffle, the same on every run."""
    return df.withColumn(
        "fold", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(folds)).cast("int")
    )


def cross_validate(
    train: DataFrame,
    models: dict[str, Model] | None = None,
    folds: int = DEFAULTS.cv_folds,
    id_col: str = "customer_unique_id",
) -> DataFrame:
    """Mean and standard deviation (population) of the AUC over the folds of ``with_folds``."""
    scored = stacked_scores(train, models or default_models(), list(range(folds)), id_col)
    each = auc_by(scored, ["model", "fold"], "label", "score", None)
    return each.groupBy("model").agg(
        F.round(F.avg("auc"), 9).alias("mean_auc"), F.round(F.stddev_pop("auc"), 9).alias("std_auc")
    )


def grid_search(
    train: DataFrame,
    grid: dict[str, list] | None = None,
    folds: int = DEFAULTS.cv_folds,
    features: list[str] = FEATURES,
    id_col: str = "customer_unique_id",
) -> tuple[DataFrame, RandomForest]:
    """Forest sizes with their cross-validated AUC, best first, and the best forest, not fitted."""
    found = forest.grid_search(train, check_inputs(features), id_col, LABEL, WEIGHT, folds, grid)
    return found, RandomForest(features, *forest.best_rule(found, len(features)))


def tuned_gain(
    tuned: Model, train: DataFrame, test: DataFrame, ranking: DataFrame, id_col: str = "customer_unique_id"
) -> DataFrame:
    """Test AUC of the tuned model and what it gains on the champion."""
    best = champion(ranking).select("AUC-ROC").scalar()
    scored = test_scores(train, test, {"tuned": tuned}, id_col)
    tested = auc(scored, "label", "score").withColumnRenamed("auc", "tuned_auc")
    return tested.withColumn("gain", F.round(F.col("tuned_auc") - best, 4))


def score_only_model(
    train: DataFrame, test: DataFrame, full_auc: float | None = None, id_col: str = "order_id"
) -> DataFrame:
    """AUC of a model that only knows the review score, and the gain of a full model on it."""
    alone = {"score": logistic_regression(["review_score"], scaled=False)}
    scored = test_scores(train, test, alone, id_col)
    found = auc(scored, "label", "score").withColumnRenamed("auc", "score_only_auc")
    if full_auc is None:
        return found
    return found.withColumn("full_gain", F.round(F.lit(full_auc) - F.col("score_only_auc"), 4))
