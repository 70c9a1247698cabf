"""Join of a fact to a table that is unique on the key, safe for hot keys.

No side is broadcast by hint but the list of hot keys, which is never longer than the number of tasks:
Spark broadcasts what it measures to be under its own threshold and shuffles the rest.  For the
shuffled case a key that would fill more than one task is spread over as many tasks as its share of
the rows would fill, and only the matching rows of the other side are repeated.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What hot_keys calls hot unless told otherwise; placement follows the number of tasks instead.
HOT_SHARE = 0.005


def tasks_of(df: DataFrame) -> int:
    """Tasks of a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _shares(df: DataFrame, key: str, limit: int) -> list[tuple]:
    """(key, share of the rows) of the ``limit`` most frequent keys.

    A frequent-items sketch of fixed size per task, merged on the way to the
    driver: one pass over one column and no shuffle of rows.
    """
    found, n = df.agg(
        F.call_function("approx_top_k", F.col(key), F.lit(limit), F.lit(limit * 20)),
        F.count(F.lit(1)),
    ).first()
    return [(x["item"], x["count"] / n) for x in found if x["item"] is not None]


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold at least ``share`` of the rows, at most 1/share of them."""
    return [k for k, part in _shares(df, key, int(1 / share)) if part >= share]


def measured_salts(df: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """(key, n_salts): keys that would fill more than one of ``tasks``, and how many they would fill.

    At most ``tasks`` rows, from one pass over one column.  The numbers only steer where rows go, so the
    error of the sketch cannot change a result; they may be stored and used for later rows too.
    """
    tasks = tasks or tasks_of(df)
    wide = [(k, ceil(part * tasks - 1e-9)) for k, part in _shares(df, key, min(tasks, 10_000))]
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_salts int"
    return df.sparkSession.createDataFrame([(k, n) for k, n in wide if n > 1], schema)


def spread_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: list[str],
    how: str = "inner",
    salts: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """``fact`` joined (inner or left) to ``dim`` (unique on ``key``).

    Rows of a hot key go to one of its tasks, chosen by a hash of the columns
    ``spread_by``: a fixed function of the row, so a re-run task sends them to
    the same place.  ``salts`` may be passed when they are already measured.
    """
    tasks = tasks or tasks_of(fact)
    if salts is None:
        salts = measured_salts(fact, key, tasks)
        if how == "inner" and salts.isEmpty():  # a local list: no job
            return fact.join(dim, key, how)
    held = F.broadcast(salts.select(F.col(key), F.col("n_salts").alias("_n")))
    left, right = fact.join(held, key, "left"), dim.join(held, key, "left")
    return _salted(left, right, key, spread_by, how, F.coalesce("_n", F.lit(1)), tasks)


def vocabulary_join(
    fact: DataFrame, names: DataFrame, key: str, spread_by: list[str], tasks: int | None = None
) -> DataFrame:
    """``fact`` left-joined to a list of names, a table of few keys that are all hot.

    Every key is spread over all tasks, and the short list is repeated for each;
    nothing has to be counted first.
    """
    tasks = tasks or tasks_of(fact)
    return _salted(fact, names, key, spread_by, "left", F.lit(tasks), tasks)


def _salted(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: list[str],
    how: str,
    n_salts: Column,
    tasks: int,
) -> DataFrame:
    """Join on key and salt; fact rows without key match nothing and are spread over all tasks."""
    wide = F.when(F.col(key).isNull(), F.lit(tasks)).otherwise(n_salts)
    left = fact.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), wide).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
    if "_n" in dim.columns:
        left, right = left.drop("_n"), right.drop("_n")
    return left.join(right, [key, "_salt"], how).drop("_salt")
