"""Size-tiered compaction: small immutable shards, merged in runs of similar size, under a versioned manifest."""

from __future__ import annotations

import json
import math
import random
import re
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import fresh

TARGET_BYTES = 128 << 20
"""Bytes aimed at for a file of a merged run. A run of so many bytes isn't merged again."""
FAN_IN = 4
"""Runs of one tier that are merged."""
FLOOR_BYTES = 1 << 20
"""Runs up to this size share the lowest tier; each tier above is FAN_IN times as large."""
NO_ARRIVAL = -(1 << 31)
"""The number that rows without an arrival number come by."""
LEASE_S = 7 * 86400.0
"""Seconds for which a writer's files are safe from vacuum() before it commits them."""

_OWN = re.compile("_(?:arrival|run)_*", re.IGNORECASE)


def ranges(numbers: Iterable[int]) -> tuple[tuple[int, int], ...]:
    """Numbers as runs of neighbours: first and last of each."""
    out: list[list[int]] = []
    for n in sorted(set(numbers)):
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return tuple((a, b) for a, b in out)


def joined(parts: Iterable[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """Ranges that touch or overlap as one."""
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple((a, b) for a, b in out)


@dataclass(frozen=True)
class Run:
    """Immutable files written together: a folder, what it holds, and the arrivals in it as ranges."""

    path: str
    bytes: int
    files: int
    rows: int
    arrivals: tuple[tuple[int, int], ...]


class ShardStore:
    """A folder of shards: `runs/` holds data that is never changed, `manifest/` one small file for each version, `writers/` a
    mark for each folder of runs that is being written.

    A version is committed by renaming a complete file to the next number, which fails if that number is there; then
    the commit is tried again on the version that won. Readers see whole versions only. What a failed or beaten writer
    left in runs/ is in no manifest, and vacuum() removes it once the writer's mark is gone or its lease has run out.

    Null values and texts of any length are kept as they are, repeated rows too. Null arrival numbers are NO_ARRIVAL. A table
    without rows is committed as a version without a run; rows() of a store without runs has the columns of what was
    appended and no rows. The store's own columns are _arrival and _run; if the data has a column of that name, it keeps it
    and the store's has an underscore more. Columns that only some arrivals have are null in the others.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, floor_bytes: int = FLOOR_BYTES, lease_s: float = LEASE_S):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.floor_bytes, self.lease_s = target_bytes, fan_in, floor_bytes, lease_s
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("manifest", "runs", "writers"):
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    # -- manifest -----------------------------------------------------------
    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int | None) -> tuple[int, list[Run], StructType]:
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, [], StructType()
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:09d}.json"))
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        runs = [Run(**r | {"arrivals": tuple(map(tuple, r["arrivals"]))}) for r in held["runs"]]
        return version, runs, StructType.fromJson(held["schema"])

    def read(self, version: int | None = None) -> tuple[int, list[Run]]:
        """A version (the latest if None) and its runs; version 0 is the empty store."""
        return self._load(version)[:2]

    def _commit(self, change: Callable[[list[Run]], list[Run] | None], columns: StructType | None = None) -> int | None:
        """Apply change(runs) to the latest version and publish the next; again on the new latest if someone was first. None
        if change gives None, as there is nothing to do any more."""
        tries = 0
        while True:
            version, runs, schema = self._load(None)
            runs = change(runs)
            if runs is None:
                return None
            known = {f.name.lower(): f for f in schema}
            for f in columns or ():
                if f.name.lower() not in known:
                    schema = StructType([*schema, StructField(f.name, f.dataType, True)])
                elif known[f.name.lower()].dataType != f.dataType:
                    raise ValueError(f"{f.name} is {f.dataType.simpleString()} here and {known[f.name.lower()].dataType.simpleString()} in the store")
            text = json.dumps({"runs": [asdict(r) for r in runs], "schema": schema.jsonValue()})
            staged = self._path(f"{self.root}/manifest/_{uuid.uuid4().hex}")
            self._write(staged, text)
            if self._publish(staged, self._path(f"{self.root}/manifest/{version + 1:09d}.json")):
                return version + 1
            self._fs.delete(staged, False)
            tries += 1
            time.sleep(random.uniform(0, min(1.0, 0.01 * 2 ** min(tries, 10))))

    def _write(self, path, text: str) -> None:
        out = self._fs.create(path, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _publish(self, staged, final) -> bool:
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE  # don't overwrite
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), none)
            return True
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise

    # -- data ---------------------------------------------------------------
    def _measure(self, path: str) -> tuple[int, int]:
        files = [s for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().endswith(".parquet")]
        return sum(s.getLen() for s in files), len(files)

    def append(self, df: DataFrame, arrival: int | None) -> int:
        """Write one arrival as small shards and commit it. An empty arrival is committed too, with no rows."""
        return self._add(df, F.lit(arrival))[-1]

    def append_many(self, df: DataFrame, arrival: str) -> list[int]:
        """Write the arrivals that a column of df numbers in one pass; each is committed as a version of its own."""
        return self._add(df.drop(arrival), F.col(f"`{arrival}`"), df)

    def _add(self, df: DataFrame, arrival, whole: DataFrame | None = None) -> list[int]:
        name = uuid.uuid4().hex
        folder, mark = f"{self.root}/runs/{name}", self._path(f"{self.root}/writers/{name}")
        self._write(mark, "")
        inward = [F.col(f"`{c}`").alias(f"{c}_" if _OWN.fullmatch(c) else c) for c in df.columns]
        rows = (df if whole is None else whole).select(*inward, F.coalesce(arrival.cast("int"), F.lit(NO_ARRIVAL)).alias("_arrival"))
        rows.write.partitionBy("_arrival").parquet(folder)
        columns = StructType([f for f in rows.schema if f.name != "_arrival"])
        found = sorted(int(s.getPath().getName().partition("=")[2]) for s in self._fs.listStatus(self._path(folder)) if s.isDirectory())
        by_path = self.spark.read.schema(columns).parquet(*[f"{folder}/_arrival={k}" for k in found]) if found else None
        counts = {int(r["k"]): r["count"] for r in by_path.groupBy(F.regexp_extract("_metadata.file_path", "_arrival=(-?[0-9]+)/[^/]*$", 1).alias("k")).count().collect()} if found else {}
        done = []
        for k in found:
            path = f"{folder}/_arrival={k}"
            size, files = self._measure(path)
            run = Run(path, size, files, counts.get(k, 0), ((k, k),))
            done.append(self._commit(lambda runs, r=run: [*runs, r] if self._holds(mark) else [], columns))
        if not done:
            done = [self._commit(lambda runs: runs, columns)]
        self._fs.delete(mark, False)
        return done

    def _holds(self, mark) -> bool:
        if not self._fs.exists(mark):
            raise RuntimeError("the writer's lease ran out, and its files were removed")
        return True

    def tier(self, run: Run) -> int:
        return 0 if run.bytes <= self.floor_bytes else math.ceil(math.log(run.bytes / self.floor_bytes, self.fan_in))

    def due(self, runs: list[Run]) -> list[Run] | None:
        """The oldest fan_in runs of the lowest tier that has so many; runs of target_bytes or more are done."""
        by: dict[int, list[Run]] = {}
        for r in runs:
            if r.bytes < self.target_bytes:
                by.setdefault(self.tier(r), []).append(r)
        return next((by[t][: self.fan_in] for t in sorted(by) if len(by[t]) >= self.fan_in), None)

    def compact(self) -> int:
        """Merge until no tier is full; the latest version. Merging moves no row between executors but by file reads:
        partitions are put together until a task writes a file of target_bytes. Another compaction that takes the same runs
        first wins, and this one goes on with what it left."""
        while group := self.due(self.read()[1]):
            files = max(1, math.ceil(sum(r.bytes for r in group) / self.target_bytes))
            name = uuid.uuid4().hex
            folder, mark = f"{self.root}/runs/{name}", self._path(f"{self.root}/writers/{name}")
            self._write(mark, "")
            self._stored(group, self._load(None)[2]).coalesce(files).write.parquet(folder)
            size, n = self._measure(folder)
            merged = Run(folder, size, n, sum(r.rows for r in group), joined(a for r in group for a in r.arrivals))
            paths = {r.path for r in group}

            def swap(runs: list[Run], merged=merged, paths=paths) -> list[Run] | None:
                if not paths <= {r.path for r in runs}:
                    return None
                at = next(k for k, r in enumerate(runs) if r.path in paths)
                return [r for r in runs[:at] if r.path not in paths] + [merged] + [r for r in runs[at:] if r.path not in paths]

            if self._commit(swap) is None:
                self._fs.delete(self._path(folder), True)
            self._fs.delete(mark, False)
        return self.read()[0]

    def _stored(self, runs: list[Run], schema: StructType, run: str | None = None) -> DataFrame:
        """Rows of runs as they lie in the files, with _arrival, and the folder they lie in if a name for it is given."""
        full = StructType([*schema, StructField("_arrival", IntegerType())])
        df = self.spark.read.schema(full).parquet(*[r.path for r in runs]) if runs else self.spark.createDataFrame([], full)
        if not runs:
            return df if run is None else df.withColumn(run, F.lit(""))
        place = F.regexp_extract("_metadata.file_path", "/runs/(.*)/[^/]*$", 1)
        of_path = F.nullif(F.regexp_extract(place, "_arrival=(-?[0-9]+)$", 1), F.lit("")).cast("int")
        return df.select(*[F.col(f"`{f.name}`") for f in schema], F.coalesce("_arrival", of_path).alias("_arrival"), *([place.alias(run)] if run else []))

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with _arrival and _run (or names with more underscores, if the data has these)."""
        _, runs, schema = self._load(version)
        df = self._stored(runs, schema, "_run")
        back = {f.name: f.name[:-1] if _OWN.fullmatch(f.name) else f.name for f in schema}
        plain = self.spark.createDataFrame([], StructType([StructField(back[f.name], f.dataType) for f in schema]))
        own = {c: fresh(plain, c) for c in ("_arrival", "_run")}
        return df.toDF(*[back.get(c) or own[c] for c in df.columns])

    def vacuum(self, keep: int = 1) -> int:
        """Delete run folders that none of the last `keep` versions names, and those versions' predecessors; how many folders
        went. Folders whose writer hasn't committed are left alone while its lease lasts; folders are listed before marks,
        and marks before manifests, so a commit in between is seen by one of them."""
        tops = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/runs"))]
        now = self.spark._jvm.System.currentTimeMillis() / 1000
        marks = {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self._fs.listStatus(self._path(f"{self.root}/writers"))}
        versions = self.versions()
        named = {r.path for v in versions[-keep:] for r in self.read(v)[1]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/{v:09d}.json"), False)
        gone = 0
        for top in tops:
            base = f"{self.root}/runs/{top.getName()}"
            if base in named or marks.get(top.getName(), self.lease_s) < self.lease_s:
                continue
            parts = [f"{base}/{s.getPath().getName()}" for s in self._fs.listStatus(top) if s.isDirectory()]
            dead = [p for p in parts if p not in named]
            if dead or not parts:
                self._fs.delete(self._path(f"{self.root}/writers/{top.getName()}"), False)  # its writer can't commit any more
            for p in dead if len(dead) < len(parts) else [base]:
                gone += bool(self._fs.delete(self._path(p), True))
        return gone
