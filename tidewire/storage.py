"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local session without one gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidewire-{uuid.uuid4().hex}/{name}"


def stored(spark: SparkSession, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and losing an executor loses nothing."""
    path = new_folder(spark, name)
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables that stored() writes inside are deleted at the end, but for those given to the function that it yields; these
    go at the end of the scratch around it, if there is one. What a result that isn't computed yet reads must be given."""
    outer, mine, kept = _written.get(), [], set()
    token = _written.set(mine)
    try:
        yield lambda *dfs: kept.update(df._folder for df in dfs)
    finally:
        _written.reset(token)
        for path in mine:
            if path not in kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            elif outer is not None:
                outer.append(path)


SPREAD_BYTES = 256 << 20
"""Inputs up to this size may be dealt out anew."""


def spread(spark: SparkSession, df: DataFrame, most: int = 1 << 30) -> DataFrame:
    """A small input in fewer files than there are cores, dealt out over all of them before work that costs far more than
    moving it. Anything larger stays as it lies."""
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = min(cores, most)
    return df.repartition(cores) if size <= SPREAD_BYTES and len(df.inputFiles()) < cores else df


def tasks_of(sizes: dict, tasks: int) -> dict:
    """The task of each key, of at most so many: keys with the most rows first, each to the task with the fewest."""
    heap, of = [(0, k) for k in range(max(1, min(tasks, len(sizes))))], {}
    for key, n in sorted(sizes.items(), key=lambda x: -x[1]):
        held, of[key] = heapq.heappop(heap)
        heapq.heappush(heap, (held + n, of[key]))
    return of


FEW_BYTES = 8 << 20
"""Bytes up to which a table of distinct values is broadcast."""


def by_distinct(df: DataFrame, columns: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(df), where make adds columns that depend on the given ones alone. If the rows repeat so few values of these that a
    table of them can be broadcast, they are made once a value, not once a row; otherwise, and in streams, of every row.

    Values are counted as partial aggregates, which fit the broadcast if they fit at all, so a count beyond it stops early."""
    if df.isStreaming:
        return make(df)
    spark = df.sparkSession
    bytes_of = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(64))
    most = FEW_BYTES // 64
    values = stored(spark, df.select(*columns).distinct().limit(most + 1), "values")
    n, size = values.agg(F.count("*"), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    if n > most or size > FEW_BYTES:
        return make(df)
    made = make(spread(spark, values, n // 8 + 1))
    new = [c for c in made.columns if c not in columns]
    made = stored(spark, made, "made")
    keys = {c: f"_value_{k}" for k, c in enumerate(columns)}
    right = F.broadcast(made.select(*[F.col(c).alias(k) for c, k in keys.items()], *new))
    df = df.drop(*new)
    same = [df[c].eqNullSafe(right[k]) for c, k in keys.items()]
    return df.join(right, same, "left").select(*[df[c] for c in df.columns], *new)
