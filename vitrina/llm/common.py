"""What the operators share: cut points of the lineage, broadcasts by size, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.sources.scratch import new_path

#: A side is broadcast up to this many bytes of rows, counted before.
BROADCAST_BYTES = 64 * 1024 * 1024


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the application's shared folder (which goes when it ends) and read it back, so that a
    lost executor costs no recomputation beyond this point.  The path is in ``df.vitrina_path``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)  # a file a partition
    out = spark.read.schema(df.schema).parquet(path)
    out.vitrina_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table of :func:`cut` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.vitrina_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast if ``rows`` counted rows fit; else leave the join to be a shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def broadcast_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver, a few for each partition at most, as a side to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def tree_merged(parts: DataFrame, read: Callable[[bytes], object], merge: Callable[[object, object], object], none: object) -> object:
    """The only (binary) column of ``parts``, a row a partition, read and merged over a tree: the
    driver gets about the cube root of their number.  ``none`` if there is no partition."""
    rdd = parts.rdd.map(lambda r: read(bytes(r[0])))
    return rdd.treeReduce(merge, depth=3) if rdd.getNumPartitions() else none


def text_slices(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The UTF-8 bytes of about ``most`` bytes of texts on end (at least one text), where each begins (and the end), and
    the first text's row; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield data[at[first] : at[last]], at[first : last + 1] - at[first], first
        first = last


def slices(texts: list[str | None], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch holding about ``most`` characters (at least one text)."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once for the row."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Items of a block of :func:`running`.
BLOCK = 64


def running(items: Column, value: Callable[[Column], Column], plus: Callable[[Column, Column], Column], zero: int) -> Column:
    """``struct(x, before)`` of each item of an array: ``before`` is ``plus`` over the values of all items before it,
    ``zero`` (which changes nothing) before the first.
    They are taken within blocks and over whole blocks before, so a long array takes little more
    than time in proportion (an aggregation that collects an array copies it at each step)."""

    def over(blocks: Column, totals: Column) -> Column:
        def block(own: Column, b: Column) -> Column:
            start = F.aggregate(F.slice(totals, F.lit(1), b), F.lit(zero), lambda a, y: plus(a, y))
            each = lambda off: F.transform(own, lambda x, j: F.struct(x.alias("x"), F.aggregate(F.slice(own, F.lit(1), j), off, lambda a, y: plus(a, value(y))).alias("before")))
            return let(start, each)

        return F.flatten(F.transform(blocks, block))

    def blocked(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)))
        blocks = F.when(F.size(all_) > 0, blocks).otherwise(F.slice(F.array(all_), F.lit(1), F.lit(0)))
        totals = lambda bs: F.transform(bs, lambda own: F.aggregate(own, F.lit(zero), lambda a, y: plus(a, value(y))))
        return let(blocks, lambda bs: let(totals(bs), lambda ts: over(bs, ts)))

    return let(items, blocked)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list by alternating star contraction.

    Returns ``(node, component)`` for every node on an edge to another node, where
    ``component`` is the smallest node reachable.  Each half round points the neighbours of
    a node at the smallest of them, so the depth falls geometrically whatever the shape; the
    edge list is written to the shared folder after each round.  A hub's edges are
    pre-aggregated before the shuffle, and no group is gathered in one task.
    Null ends and loops are ignored; no edges give no rows.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u, v).distinct(), "edges")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = signature(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        then = cut(small, "edges")
        drop_cut(now)
        now, before, seen = then, seen, signature(then)
        if seen == before:
            break
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    out = roots.select(F.col("u").alias("node"), "component").unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
    out = cut(out, "components")
    drop_cut(now)
    return out
