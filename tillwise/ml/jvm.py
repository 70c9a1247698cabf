"""Java functions for the loops that numpy cannot express, and the packed rows they read.

The sources in ``java`` are compiled on the driver by Janino, the compiler that Spark brings along for its
own generated code, and sent to the executors as a jar: no other tool is needed on any machine.
"""

from __future__ import annotations

import io
import struct
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from importlib.resources import files
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from tillwise.ml.trees import BLOCK_ROWS, Nodes, Part, Rows

CLASSES = ("ForestPart", "ForestValues")
BLOCK_SCHEMA = "part int, block binary"


def java_function(spark: SparkSession, name: str) -> Callable[..., Column]:
    """The class ``tillwise.<name>`` as a function of columns that returns an array of byte strings."""
    sc, jvm = spark.sparkContext, spark._jvm
    loader = getattr(sc, "_tillwise_java", None)
    if loader is None:
        jar, loader = io.BytesIO(), {}
        with zipfile.ZipFile(jar, "w") as z:
            for c in CLASSES:
                compiler = jvm.org.codehaus.janino.SimpleCompiler()
                compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
                compiler.cook(files(__package__).joinpath("java", f"{c}.java").read_text())
                for made, code in compiler.getBytecodes().items():
                    z.writestr(made.replace(".", "/") + ".class", bytes(code))
                loader[c] = compiler.getClassLoader()
        target = Path(tempfile.mkdtemp(prefix="tillwise-")) / "tillwise-loops.jar"
        target.write_bytes(jar.getvalue())
        sc._jsc.addJar(str(target))
        sc._tillwise_java = loader
    made = loader[name].loadClass(f"tillwise.{name}").getDeclaredConstructors()[0]
    function = made.newInstance(sc._gateway.new_array(jvm.java.lang.Object, 0))
    kind = spark._jsparkSession.parseDataType(ArrayType(BinaryType()).json())
    spark._jsparkSession.udf().register(f"tillwise_{name}", function, kind)
    return lambda *columns: F.call_udf(f"tillwise_{name}", *columns)


def packed(data: Rows) -> bytes:
    """Number of rows, then column after column; bins take a byte each."""
    columns = [(data.row, "<i8"), (data.weight, "<f8"), (data.fold, "<i4"), (data.label, "<i4"), (data.x.T, "u1")]
    return struct.pack("<i", len(data.row)) + b"".join(np.ascontiguousarray(c, kind).tobytes() for c, kind in columns)


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """``Rows`` of some batches each, ``BLOCK_ROWS`` or little more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK_ROWS:
            yield Rows.of(pa.Table.from_batches(held))
            held = []
    if sum(x.num_rows for x in held):
        yield Rows.of(pa.Table.from_batches(held))


def blocks_of_parts(rows: DataFrame, parts: int, deal: Callable[[Rows], Iterator[tuple[int, Rows]]] | None) -> DataFrame:
    """``BLOCK_SCHEMA``: every block in every part, or as ``deal`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in in_blocks(batches):
            for part, mine in deal(data) if deal else [(-1, data)]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([packed(mine)], pa.binary())], names=["part", "block"]
                )

    blocks = rows.mapInArrow(run, BLOCK_SCHEMA)
    if deal:
        return blocks
    return blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block")


def over_parts(function: Callable[..., Column], specifications: list[bytes], blocks: DataFrame) -> DataFrame:
    """``out``: what ``function`` makes of each part's specification and blocks, a task for each part."""
    listed = F.array(*[F.lit(s) for s in specifications])
    dealt = blocks.repartitionById(len(specifications), F.col("part"))
    whole = dealt.groupBy("part").agg(F.collect_list("block").alias("blocks"))
    return whole.select(F.explode(function(F.get(listed, F.col("part")), F.col("blocks"))).alias("out"))


def forest_part(
    part: Part,
    width: int,
    unit: float,
    poisson: np.ndarray,
    stops: list[tuple[int, int]] | None,
    trees_a_fit: int,
) -> bytes:
    """What ``ForestPart`` does with a part; ``stops`` are those it scores held-out rows under."""
    rule = part.trees[0].rule
    depth = -1 if rule.max_depth is None else rule.max_depth
    fit, first = divmod(part.trees[0].number, trees_a_fit)
    out = [struct.pack("<6i", stops is not None, width, depth, rule.min_split, rule.min_leaf, rule.features_per_split or 0)]
    out.append(struct.pack(f"<di{len(poisson)}d", unit, len(poisson), *poisson))
    out.append(struct.pack(f"<i{2 * len(stops or [])}i", len(stops or []), *[v for s in stops or [] for v in s]))
    out.append(struct.pack("<3i", fit, first, part.trees[0].fold))
    signed = np.array([part.key or 0, *[t.key for t in part.trees]], np.uint64).astype(np.int64).tolist()
    out.append(struct.pack("<2q3i3q", part.node, signed[0], part.key is not None, part.done is not None, part.depth, *(part.done or (0, 0, 0))))
    out.append(struct.pack("<i", len(part.trees)))
    out += [struct.pack("<2q", t.number, k) for t, k in zip(part.trees, signed[1:], strict=True)]
    return b"".join(out)


def packed_tree(nodes: Nodes) -> bytes:
    """Number of nodes, then column after column: feature, bin, children, weight of the rows, class 1 share."""
    cover = np.maximum(nodes.a + nodes.b, 1)
    columns = [(c, "<i4") for c in (nodes.feature, nodes.bin, nodes.left, nodes.right)]
    columns += [(cover, "<f8"), (nodes.a / cover, "<f8")]
    return struct.pack("<i", len(cover)) + b"".join(c.astype(kind).tobytes() for c, kind in columns)


def over_pairs(function: Callable[..., Column], specification: bytes, trees: DataFrame, rows: DataFrame, slices: int, blocks: int) -> DataFrame:
    """``out``: what ``function`` makes of each slice of packed trees and each block of packed rows, a task a pair.

    ``trees`` are (part, block) with the slice as part, ``rows`` with the number of the block.
    """
    def spread(count, pair):
        return F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), pair)).alias("pair")

    left = trees.select(spread(blocks, lambda b: F.col("part") * blocks + b), F.col("block").alias("tree"), F.lit(None).cast("binary").alias("rows"))
    right = rows.select(spread(slices, lambda s: s * blocks + F.col("part")), F.lit(None).cast("binary").alias("tree"), F.col("block").alias("rows"))
    dealt = left.union(right).repartitionById(slices * blocks, F.col("pair"))
    whole = dealt.groupBy("pair").agg(F.collect_list("tree").alias("trees"), F.collect_list("rows").alias("rows"))
    return whole.select(F.explode(function(F.lit(specification), F.col("trees"), F.col("rows"))).alias("out"))
