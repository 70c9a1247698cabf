"""Global order statistics without a global sort in one task.

``NTILE(k) OVER (ORDER BY ...)`` and running totals over all rows put every row
into a single task when written as a window.  Both are answered here in two
rounds that only send a few rows to the driver:

1. rows are range-partitioned by Spark; every partition reports its first key
   and its totals (as many reports as there are shuffle partitions);
2. the reports say which key ranges matter, and those are looked up by value.

Ranges are compared by value in round 2, so how Spark happened to cut the
partitions in round 1, or a re-run of a lost task, cannot change a result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType
from pyspark.sql.window import Window as W

from tillwise.session import materialize


def first_per_key(df: DataFrame, keys: list[str], order_cols: list[str]) -> DataFrame:
    """The first row of each key in the order of ``order_cols`` (unique within a key).

    An aggregate, not a window: rows of a hot key are cut down to one per task
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    kept = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_row")
    )
    return kept.select(*keys, "_row.*").select(*df.columns)


def top_k(df: DataFrame, by: str, k: int, tie_break: list[str]) -> DataFrame:
    """Largest ``by`` first, NULL before all, ties by ``tie_break``."""
    return df.orderBy(F.col(by).desc_nulls_first(), *[F.col(c).asc() for c in tie_break]).limit(k)


def _key(which: int, col: Column, descending: bool, id_col: str) -> Column:
    """Sort key: ascending puts NULL last, descending puts NULL first."""
    flag = col.isNotNull() if descending else col.isNull()
    return F.struct(
        F.lit(which).alias("w"),
        flag.alias("f"),
        (-col if descending else col).alias("v"),
        F.col(id_col).alias("i"),
    )


def _range_reports(keyed: DataFrame) -> list[Row]:
    """First key and row count of each range partition, one row per partition and ``w``."""
    ranged = keyed.repartitionByRange("k.w", "k.f", "k.v", "k.i")
    per_part = ranged.groupBy(F.spark_partition_id().alias("pid"), F.col("k.w").alias("w"))
    return per_part.agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo")).collect()


def _literal_key(row: Row, key_type: DataType) -> Column:
    """A collected key as a literal struct of the same type."""
    return F.struct(*[F.lit(row[n]).alias(n) for n in ["w", "f", "v", "i"]]).cast(key_type)


def keys_at_ranks(keyed: DataFrame, ranks) -> dict[int, dict[int, Row]]:
    """Keys that stand at given 1-based ranks.

    ``keyed`` has one column ``k`` = struct(w, f, v, i), unique per row; ranks
    are counted within each ``w``.  ``ranks(w, n)`` names the wanted ranks of a
    group of ``n`` rows.  Returns {w: {rank: key}}.
    """
    found: dict[int, dict[int, Row]] = {}
    todo = []
    reports = _range_reports(keyed)
    for w in sorted({r["w"] for r in reports}):
        mine = sorted((r for r in reports if r["w"] == w), key=_report_order)
        ends = list(accumulate(r["n"] for r in mine))
        found[w] = {}
        for rank in ranks(w, ends[-1]):
            at = next(j for j, end in enumerate(ends) if rank <= end)
            local = rank - (ends[at - 1] if at else 0)
            if local == 1:
                found[w][rank] = mine[at]["lo"]
            else:
                hi = mine[at + 1]["lo"] if at + 1 < len(mine) else None
                todo.append((w, rank, local, mine[at]["lo"], hi))
    if todo:
        spans = {}
        for w, _, _, lo, hi in todo:
            spans.setdefault((w, tuple(lo)), (len(spans), lo, hi))
        key, key_type = F.col("k"), keyed.schema["k"].dataType
        span = F.lit(None).cast("int")
        for number, lo, hi in spans.values():
            inside = (F.col("k.w") == lo["w"]) & (key >= _literal_key(lo, key_type))
            if hi is not None:
                inside &= key < _literal_key(hi, key_type)
            span = F.when(inside, F.lit(number)).otherwise(span)
        wanted = {}
        for w, rank, local, lo, _ in todo:
            wanted[(spans[(w, tuple(lo))][0], local)] = (w, rank)
        locals_of = {}
        for number, local in wanted:
            locals_of.setdefault(number, []).append(local)
        pick = F.lit(False)
        for number, numbers in locals_of.items():
            pick |= (F.col("s") == number) & F.col("rn").isin(numbers)
        rows = (
            keyed.withColumn("s", span)
            .filter(F.col("s").isNotNull())
            .withColumn("rn", F.row_number().over(W.partitionBy("s").orderBy("k")))
            .filter(pick)
            .collect()
        )
        for r in rows:
            w, rank = wanted[(r["s"], r["rn"])]
            found[w][rank] = r["k"]
    return found


def _report_order(report: Row):
    lo = report["lo"]
    return (lo["f"], lo["v"] is not None, lo["v"] if lo["v"] is not None else 0, lo["i"])


def _at_or_after(key: Row, flag: Column, value: Column, ident: Column) -> Column:
    """Whether (flag, value, id) sorts at or after the collected key."""
    same_id = ident >= F.lit(key["i"])
    if key["v"] is None:
        tail = value.isNotNull() | same_id
    else:
        tail = value.isNotNull() & ((value > F.lit(key["v"])) | ((value == F.lit(key["v"])) & same_id))
    at = F.lit(key["f"])
    return (flag & ~at) | ((flag == at) & tail)


def ntile_distributed(
    df: DataFrame, k: int, keys: dict[str, tuple[Column, bool]], id_col: str
) -> DataFrame:
    """Adds NTILE(k) columns; ``keys`` = {name: (whole-number column, descending)}.

    Ties are ordered by ``id_col`` (unique).  All tilings share the two rounds;
    the result is a projection of ``df`` that compares each row with the k-1
    boundary keys, so it moves no rows.  ``df`` is read three times: pass a
    table or a materialized frame.
    """
    names = list(keys)
    structs = [_key(n, *keys[name], id_col) for n, name in enumerate(names)]
    keyed = df.select(F.explode(F.array(*structs)).alias("k"))

    found = keys_at_ranks(keyed, _tile_starts(k))
    out = df
    for n, name in enumerate(names):
        col, descending = keys[name]
        flag = col.isNotNull() if descending else col.isNull()
        value = -col if descending else col
        tile = F.lit(1)
        for rank in sorted(found.get(n, {})):
            later = _at_or_after(found[n][rank], flag, value, F.col(id_col))
            tile = tile + F.when(later, F.lit(1)).otherwise(F.lit(0))
        out = out.withColumn(name, tile.cast("int"))
    return out


def tile_boundaries(
    df: DataFrame, k: int, keys: dict[str, tuple[Column, bool]], id_col: str
) -> DataFrame:
    """(name, f, v, i): the first sort key of every tile but the first, as ``ntile_distributed`` cuts.

    At most k - 1 rows a name, to be stored and used by ``with_tiles``.  ``df`` is read twice.
    """
    structs = [_key(n, *keys[name], id_col) for n, name in enumerate(keys)]
    found = keys_at_ranks(df.select(F.explode(F.array(*structs)).alias("k")), _tile_starts(k))
    names = list(keys)
    rows = [
        (names[n], key["f"], key["v"], key["i"]) for n, by_rank in found.items() for key in by_rank.values()
    ]
    kind = df.schema[id_col].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"name string, f boolean, v bigint, i {kind}")


def _tile_starts(k: int):
    """Ranks at which tiles 2 to k begin: the first n % k tiles hold one row more."""

    def starts(_, n):
        size, extra = divmod(n, k)
        firsts = accumulate((size + (t < extra) for t in range(k - 1)), initial=1)
        return sorted({s for s in list(firsts)[1:] if s <= n})

    return starts


def _not_after(key: Column):
    return lambda bound: key >= bound


def with_tiles(
    df: DataFrame, boundaries: DataFrame, keys: dict[str, tuple[Column, bool]], id_col: str
) -> DataFrame:
    """Adds a tile column per name by comparing each row with stored ``tile_boundaries``; runs no job."""
    held = boundaries.groupBy().agg(
        *[F.collect_list(F.when(F.col("name") == n, F.struct("f", "v", "i"))).alias(n) for n in keys]
    )
    out = df.withColumn("_tiles", held.select(F.struct(*keys)).scalar())
    tiles = {}
    for name, (col, descending) in keys.items():
        flag = col.isNotNull() if descending else col.isNull()
        here = F.struct(flag.alias("f"), (-col if descending else col).alias("v"), F.col(id_col).alias("i"))
        tiles[name] = F.size(F.filter(F.col(f"_tiles.{name}"), _not_after(here))) + 1
    return out.withColumns(tiles).drop("_tiles")


def running_totals(
    df: DataFrame, order_col: str, sums: list[str], keys: list[str] | None = None
) -> DataFrame:
    """Adds ``cum_<c>`` = sum of ``c`` over the rows of the same ``keys`` with an order up to this one.

    ``order_col`` is a double, not NULL and unique within ``keys``, which are not NULL.  Rows are split
    into value ranges of about equal size; each range is summed up by its own task and shifted by what
    the ranges before it hold, which is a stored table met by range number.  The plan does not grow
    with the number of ranges.  ``df`` is read three times.
    """
    keys = keys or []
    firsts = (
        df.repartitionByRange(order_col)
        .groupBy(F.spark_partition_id())
        .agg(F.min(order_col).alias("lo"))
        .collect()
    )
    splits = [-float("inf"), *sorted(r["lo"] for r in firsts)[1:], float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol=order_col, outputCol="_range").transform(df)
    else:
        ranged = df.withColumn("_range", F.lit(0.0))
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_before_{c}") for c in sums])
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shift = materialize(
        totals.withColumns(
            {f"_before_{c}": F.coalesce(F.sum(f"_before_{c}").over(earlier), F.lit(0)) for c in sums}
        )
    )
    within = W.partitionBy(*keys, "_range").orderBy(order_col).rowsBetween(W.unboundedPreceding, 0)
    out = ranged.join(shift, [*keys, "_range"])
    cum = {f"cum_{c}": F.sum(c).over(within) + F.col(f"_before_{c}") for c in sums}
    return out.withColumns(cum).select(*df.columns, *cum)
