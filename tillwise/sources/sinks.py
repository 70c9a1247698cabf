"""Result, model and report sinks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Fitted pipeline: the feature list is in its assembler, the scaler is a stage."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a report in order, as one text file (a few dozen lines)."""
    ordered = report.coalesce(1).sortWithinPartitions("section", "seq")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
