"""Session settings and the shared scratch folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "tillwise", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators count on.

    On a cluster leave ``master`` unset: it comes from spark-submit.  Adaptive
    execution coalesces small shuffle partitions, so ``shuffle.partitions`` can
    be set for the largest job.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no call-site capture for every column expression: plans build several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors once per application, for functions that run there."""
    sc = spark.sparkContext
    if getattr(sc, "_tillwise_shipped", False):
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tillwise-")) / "tillwise.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, str(Path(home.name) / file.relative_to(home)))
    sc.addPyFile(str(target))
    sc._tillwise_shipped = True


def scratch_path(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.gettempdir() + "/tillwise-scratch"
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Used where a frame is read by several jobs (order statistics, iterative
    fits).  The copy is columnar, so each reader prunes to its own columns, and
    it outlives executors, so a lost one never re-runs the lineage before it.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
