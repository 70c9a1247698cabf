"""Reader of the raw CSV tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.sources.csvblocks import read_quoted_csv
from tillwise.sources.schemas import RAW_FILES, RAW_SCHEMAS

# Free text with line breaks.
_MULTI_LINE = {"reviews"}


def read_raw(
    spark: SparkSession,
    folder: str,
    table: str,
    pattern: str | None = None,
    with_order: bool = False,
) -> DataFrame:
    """A raw table with the types of ``RAW_SCHEMAS``; further columns stay text.

    Names come from the header and nothing is inferred from the data.
    ``with_order`` adds ``row_order``, which sorts rows as they stand in the
    files, for the operators that keep the first row.
    """
    path = f"{folder.rstrip('/')}/{pattern or RAW_FILES[table]}"
    if table in _MULTI_LINE:
        df = read_quoted_csv(spark, path)
        df = df if with_order else df.drop("row_order")
    else:
        df = spark.read.options(header=True, escape='"', mode="FAILFAST").csv(path)
    if with_order and table not in _MULTI_LINE:
        df = df.withColumn(
            "row_order",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ),
        )
    known = {c: t for c, t in RAW_SCHEMAS[table].items() if c in df.columns}
    return df.withColumns({c: F.col(c).cast(t) for c, t in known.items()}) if known else df


# Tables of which only the first of several rows is kept.
_FIRST_ROW_COUNTS = {"customers", "reviews"}


def read_all_raw(
    spark: SparkSession, folder: str, patterns: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """All raw tables; customers and reviews know the place of each row in its file.

    ``patterns`` gives file names other than the usual ones.
    """
    return {
        table: read_raw(
            spark, folder, table, (patterns or {}).get(table), with_order=table in _FIRST_ROW_COUNTS
        )
        for table in RAW_FILES
    }
