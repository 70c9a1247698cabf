"""CSV with line breaks inside quotes, read by many tasks.

Such a file cannot be cut at any line break.  Whether a break ends a record follows from the quotes
before it: an odd number leaves a field open.  So one pass counts the quotes of every file block, a
running count over the blocks says whether each begins inside a field, and a second pass lets every
task start at its first true record.  A record that runs on into the next blocks is put together from
the pieces that their tasks hand over; there are two pieces a block at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_BLOCK = ["file", "block"]
_PIECES = "file string, block bigint, row bigint, kind int, text string"

WHOLE, OPENED, RUNS_ON, CLOSED = 0, 1, 2, 3  # kinds of pieces; RUNS_ON: a whole block inside one record


def _physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they stand in the files, with the file block that a task reads them from."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def _starts_open(lines: DataFrame, quote: str) -> DataFrame:
    """(file, block, open): whether a block begins inside a quoted field; one row a block."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit(quote), F.lit("")))
    odd = lines.groupBy(*_BLOCK).agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return odd.select(*_BLOCK, (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("open"))


def _pieces(starts: dict[tuple[str, int], bool], quote: str):
    """Records of a task's blocks, and the pieces of records that cross a block's border."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, row, held, inside, entered = None, 0, [], False, False
        out: list[tuple] = []

        def leave() -> None:
            if here is not None and held:  # the block ends inside a record
                out.append((*here, row, RUNS_ON if entered else OPENED, "\n".join(held)))

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("file", "block", "line")]
            for file, block, line in zip(*columns, strict=True):
                if here != (file, block):
                    leave()
                    here, row, held = (file, block), 0, []
                    inside = entered = starts[here]
                line = line.removesuffix("\r")
                held.append(line)
                inside ^= line.count(quote) % 2 == 1
                if not inside:
                    out.append((*here, row, CLOSED if entered else WHOLE, "\n".join(held)))
                    row, held, entered = row + 1, [], False
            if out:
                yield batch(out)
                out = []
        leave()
        if out:
            yield batch(out)

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """Records put together from the pieces that cross borders, under the place where they begin."""
    order = W.partitionBy("file").orderBy("block", "row")
    begun = pieces.withColumn("_n", F.sum((F.col("kind") == OPENED).cast("int")).over(order))
    place = F.struct("block", "row", "text")
    whole = begun.groupBy("file", "_n").agg(F.array_sort(F.collect_list(place)).alias("p"))
    return whole.select(
        "file",
        F.col("p")[0]["block"].alias("block"),
        F.col("p")[0]["row"].alias("row"),
        F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
    )


def read_quoted_csv(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """The rows of CSV files as text columns named by their header, with ``row_order``.

    Fields may hold line breaks, doubled quotes and separators; lines may end in CR LF, which counts
    as a line break inside fields too.  Every file has the same header.  ``row_order`` sorts the rows
    as they stand in the files.  A row that does not fit the header is an error.

    The driver gets one flag a file block; records that cross blocks are two rows a block at most.
    """
    names = spark.read.options(header=True, multiLine=True, escape=quote).csv(path).columns
    lines = _physical_lines(spark, path)
    starts = {(r["file"], r["block"]): r["open"] for r in _starts_open(lines, quote).collect()}
    pieces = lines.mapInArrow(_pieces(starts, quote), _PIECES)
    whole = pieces.filter(F.col("kind") == WHOLE).drop("kind")
    records = whole.unionByName(_joined(pieces.filter(F.col("kind") != WHOLE)))
    # blank lines are no rows; the first record of a file is its header
    records = records.filter((F.trim("text") != "") & ~((F.col("block") == 0) & (F.col("row") == 0)))
    schema = ", ".join(f"`{n}` string" for n in names)
    options = {"quote": quote, "escape": quote, "mode": "FAILFAST"}
    parsed = records.select(
        F.from_csv("text", F.lit(schema), options).alias("_r"), F.struct("file", "block", "row").alias("row_order")
    )
    return parsed.select("_r.*", "row_order")
