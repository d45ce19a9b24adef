"""Shared pieces: durable intermediate tables, Arrow text buffers, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_folder, scratch, stored  # noqa: F401

BATCH_BYTES = 8 << 20
"""Bytes of an Arrow batch of texts; Spark's own limit is eight times as much, of which JVM and Python hold several copies."""

if TaskContext.get() is not None:  # in an executor's Python worker, give freed batches back to the system
    pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 1 << 20)  # arrays from a megabyte on are mapped, so that they go back when freed

BROADCAST_LIMIT = 8 << 20
"""Bytes up to which a counted table may be broadcast; beyond it joins shuffle."""


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    return stored(spark, df, label, "zstd")


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches to BATCH_BYTES where the session leaves Spark's default."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH_BYTES}b")


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only if the counted rows stay under BROADCAST_LIMIT."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df


def ascii_lower(col):
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


STEP = 256
"""Entries of an array that are worked on together where each depends on those before it."""


def blocks(entries: Column) -> Column:
    """An array in arrays of STEP; of an empty one, an empty array."""
    return F.transform(_block_starts(entries), lambda b: F.slice(entries, b + 1, STEP))


def _block_starts(entries: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(entries) - 1, F.lit(0)), F.lit(STEP))


def laid_out(parts: Column, width: Callable[[Column], Column], make: Callable[[Column, Column], Column], kind: str) -> Column:
    """An array of make(part, start), each of a given type, of parts that lie end to end and are width(part) long. By blocks, as
    every append copies an array."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, p: a + width(p))

    def block(x, start):
        zero = F.struct(start.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        add = lambda a, p: F.struct((a["at"] + width(p)).alias("at"), F.concat(a["out"], F.array(make(p, a["at"]))).alias("out"))
        return F.aggregate(x, zero, add)["out"]

    def whole(known):
        starts = F.aggregate(blocks(known), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + total(x))))
        return F.flatten(F.zip_with(blocks(known), F.slice(starts, 1, F.size(_block_starts(known))), block))

    return F.get(F.transform(F.array(parts), whole), F.lit(0))  # parts are made once


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row's begin (one more than rows). Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], pa.string())
    col = pc.fill_null(col, "").cast(pa.large_binary())
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` bytes together; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), both long; root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes, which takes rounds in the logarithm of the longest
    chain. Minima are pre-aggregated and written, so that the joins on a node with very many edges are plain shuffled joins
    whose hot partitions Spark splits. Only the last round's table stays.
    """
    with scratch(spark) as last:
        now = materialize(
            spark,
            edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
            "edges",
        )
        was, mark = None, _mark(now)
        while mark != was:
            with scratch(spark) as keep:
                both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
                least = materialize(spark, both.groupBy("u").agg(F.min("v").alias("m")), "least")
                large = materialize(
                    spark,
                    both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(),
                    "large",
                )
                low = materialize(spark, large.groupBy("u").agg(F.min("v").alias("m")), "low")
                small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                now = materialize(spark, small.union(low).distinct(), "small")
                was, mark = mark, _mark(now)
                keep(now)
        last(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
