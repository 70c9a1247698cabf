"""Customer clusters on recency, frequency and monetary value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import cents, money, ratio_round
from tillwise.ml import kmeans
from tillwise.params import DEFAULTS
from tillwise.session import materialize

# fixed values: inputs and tried cluster counts
RFM_COLUMNS = ["recency_days", "frequency", "monetary"]
CLUSTER_COUNTS = range(2, 9)


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds z_<c> = (c - mean) / population deviation, 0 for a constant column.

    ``df`` is read twice.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
            *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
        )
    ).scalar()
    scaled = {}
    for c in cols:
        gap = F.col(c).cast("double") - F.col(f"_s.m_{c}")
        scaled[f"z_{c}"] = F.coalesce(gap / F.nullif(F.col(f"_s.s_{c}"), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("_s", stats).withColumns(scaled).drop("_s")


def _points(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without NULL with their standardized coordinates z and a hash of the row, stored."""
    whole = materialize(df.dropna())
    row = F.xxhash64(*whole.columns)
    scaled = standardize(whole, cols).withColumns({"z": F.array(*[f"z_{c}" for c in cols]), "row": row})
    return materialize(scaled.drop(*[f"z_{c}" for c in cols]))


def _starts(starts: int) -> list[int]:
    return [DEFAULTS.seed + i for i in range(starts)]


def kmeans_scan(
    df: DataFrame, cols: list[str] | None = None, ks=CLUSTER_COUNTS, starts: int = 10
) -> DataFrame:
    """Inertia and (squared-Euclidean) silhouette of the best start for each number of clusters."""
    points = _points(df, cols or RFM_COLUMNS).select("z", "row")
    best = kmeans.best_of(kmeans.fit_all(points, list(ks), _starts(starts)))
    shapes = kmeans.silhouettes(points, list(best.values())) if best else []
    rows = [(f.k, float(f.inertia), float(s)) for f, s in zip(best.values(), shapes, strict=True)]
    schema = "k int, inertia double, silhouette double"
    return df.sparkSession.createDataFrame(rows, schema)


def best_k(scan: DataFrame) -> int:
    """Number of clusters with the largest silhouette, the least of equals."""
    return scan.orderBy(F.col("silhouette").desc(), "k").first()["k"]


def cluster_segments(
    df: DataFrame, cols: list[str] | None = None, ks=CLUSTER_COUNTS, starts: int = 10
) -> DataFrame:
    """Labelled profile of the clusters for the number of clusters with the best silhouette."""
    stored = materialize(df)
    k = best_k(kmeans_scan(stored, cols, ks, starts))
    return cluster_label(cluster_profile(kmeans_assign(stored, k, cols, starts)))


def kmeans_assign(
    df: DataFrame, k: int, cols: list[str] | None = None, starts: int = 10
) -> DataFrame:
    """Rows without NULL with their cluster number."""
    points = _points(df, cols or RFM_COLUMNS)
    best = kmeans.best_of(kmeans.fit_all(points.select("z", "row"), [k], _starts(starts)))
    return points.withColumn("cluster", _nearest(best[k].centres if best else [])).drop("z", "row")


def _nearest(centres) -> Column:
    """Number of the nearest of a few centres, the least of equals."""
    if not len(centres):
        return F.lit(0)
    far = [
        F.struct(
            reduce(Column.__add__, [F.pow(F.col("z")[i] - F.lit(float(v)), F.lit(2.0)) for i, v in enumerate(c)]),
            F.lit(n).alias("n"),
        )
        for n, c in enumerate(centres)
    ]
    return F.array_min(F.array(*far))["n"]


def cluster_profile(df: DataFrame) -> DataFrame:
    """Customers and mean recency, frequency and spend per cluster, 2 digits."""
    n = F.count(F.lit(1))
    return df.groupBy("cluster").agg(
        n.alias("customer_count"),
        ratio_round(F.sum("recency_days"), n, 2).alias("avg_recency"),
        ratio_round(F.sum("frequency"), n, 2).alias("avg_frequency"),
        money(ratio_round(F.sum(cents("monetary")), n)).alias("avg_monetary"),
    )


def label_of(recency: Column, frequency: Column, monetary: Column) -> Column:
    # fixed values: bounds of the behaviour labels; the first rule that holds wins
    return (
        F.when((recency < 60) & (monetary > 200), "High Value Active")
        .when((recency < 90) & (frequency > 1), "Loyal Regulars")
        .when((recency > 150) & (monetary > 150), "Lapsed High Value")
        .when(recency > 150, "Churned Low Value")
        .otherwise("Occasional Buyers")
    )


def cluster_label(profile: DataFrame) -> DataFrame:
    label = label_of(F.col("avg_recency"), F.col("avg_frequency"), F.col("avg_monetary"))
    return profile.withColumn("label", label)
