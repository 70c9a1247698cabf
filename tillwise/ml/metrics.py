"""Evaluation of scored rows, exact and without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import ratio_round
from tillwise.operators.ranking import running_totals
from tillwise.session import materialize


def _score_counts(scored: DataFrame, label: str, score: str, keys: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score with running totals from the top."""
    hit = F.col(label) == 1
    counts = (
        scored.withColumn("down", -F.col(score).cast("double"))
        .groupBy(*(keys or []), "down")
        .agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))
    )
    return running_totals(materialize(counts), "down", ["pos", "neg"], keys)


def roc_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rate when rows at or above each distinct score count as positive.

    The curve begins at (0, 0) with an infinite threshold, above all scores.
    """
    counts = _score_counts(scored, label, score)
    ends = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    start = counts.sparkSession.sql("SELECT double('Infinity') threshold, 0.0D fpr, 0.0D tpr")
    curve = counts.withColumn("_e", ends).select(
        (F.lit(0.0) - F.col("down")).alias("threshold"),  # never -0.0
        (F.col("cum_neg") / F.nullif(F.col("_e.n"), F.lit(0))).alias("fpr"),
        (F.col("cum_pos") / F.nullif(F.col("_e.p"), F.lit(0))).alias("tpr"),
    )
    return start.union(curve)


def _area(digits: int | None) -> Column:
    """Area from ``_score_counts``: every negative meets the positives scored above it."""
    above = F.col("cum_pos") - F.col("pos")
    pairs = F.sum(F.col("neg").cast("decimal(19,0)") * (2 * above + F.col("pos")))
    every = F.sum("pos").cast("decimal(14,0)") * F.sum("neg").cast("decimal(14,0)") * 2
    if digits is None:
        return pairs.cast("double") / F.nullif(every.cast("double"), F.lit(0.0))
    return ratio_round(pairs, every, digits)


def auc(scored: DataFrame, label: str, score: str, digits: int = 4) -> DataFrame:
    """Area under the ROC curve as one row; equal scores count half."""
    return _score_counts(scored, label, score).agg(_area(digits).alias("auc"))


def auc_by(
    scored: DataFrame, keys: list[str], label: str, score: str, digits: int | None = 4
) -> DataFrame:
    """Area under the ROC curve for each combination of ``keys``, all by one ranked aggregation.

    Keys may be NULL.  A combination with one class only has no area (NULL).
    """
    keyed = scored.withColumn("_key", F.struct(*keys))
    areas = _score_counts(keyed, label, score, ["_key"]).groupBy("_key").agg(_area(digits).alias("auc"))
    return areas.select("_key.*", "auc")


def classification_metrics_by(
    scored: DataFrame,
    keys: list[str],
    label: str = "label",
    score: str = "score",
    prediction: str = "prediction",
) -> DataFrame:
    """AUC-ROC, Precision, Recall and F1-Score of class 1 for each combination of ``keys``, 4 digits.

    ``scored`` is read twice, whatever the number of combinations.
    """
    hit, said = F.col(label) == 1, F.col(prediction) == 1
    keyed = scored.withColumn("_key", F.struct(*keys))
    confusion = keyed.groupBy("_key").agg(
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"),
    )
    area = _score_counts(keyed, label, score, ["_key"]).groupBy("_key").agg(_area(4).alias("auc"))
    return area.join(confusion, "_key").select("_key.*", *_shown(*(F.col(c) for c in ("auc", "tp", "fp", "fn"))))


def _shown(area: Column, tp: Column, fp: Column, fn: Column) -> list[Column]:
    def or_zero(num, den):
        return F.coalesce(ratio_round(num, den, 4), F.lit(0.0))

    return [
        area.alias("AUC-ROC"),
        or_zero(tp, tp + fp).alias("Precision"),
        or_zero(tp, tp + fn).alias("Recall"),
        or_zero(tp * 2, tp * 2 + fp + fn).alias("F1-Score"),
    ]


def classification_metrics(
    scored: DataFrame, label: str = "label", score: str = "score", prediction: str = "prediction"
) -> DataFrame:
    """AUC-ROC, Precision, Recall and F1-Score of class 1 in one row, 4 digits.

    ``scored`` is read twice.
    """
    hit, said = F.col(label) == 1, F.col(prediction) == 1
    confusion = scored.agg(
        F.struct(
            F.count_if(hit & said).alias("tp"),
            F.count_if(~hit & said).alias("fp"),
            F.count_if(hit & ~said).alias("fn"),
        )
    )
    area = auc(scored, label, score)
    c = area.withColumn("_c", confusion.scalar())
    return c.select(*_shown(F.col("auc"), *(F.col(f"_c.{x}") for x in ("tp", "fp", "fn"))))
