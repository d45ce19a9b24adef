"""Near duplicates: SimHash fingerprints linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, materialize, scratch, utf8

BITS = 64
RADIUS = 3
"""Most differing bits of a link. One side meets the other within NEAR bits, the other within FAR: together RADIUS."""
NEAR, FAR = RADIUS // 2, RADIUS - RADIUS // 2
GROUP = 512
"""Fingerprints aimed at for each prefix of the variants."""
SUB_BITS = 6
"""Further bits by which a hot prefix is split, again and again until none is hot."""
MOST_HOT = 1_000_000
"""Hot prefixes of one length at most: beyond so many, prefixes count as hot from a larger size on."""
AT_ONCE = 2_000_000
"""Variants that a task holds at a time."""


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of UTF-8 text: a bit is 1 if over half of the shingles' XXH64 (seed 42) have it; no words: 0."""
    w = text.lower().split()  # of bytes: A-Z only, and blanks \\x20 \\x09-\\x0D
    if not w:
        return 0
    if len(w) <= shingle:
        h = [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    else:
        h = [xxhash.xxh64_intdigest(b" ".join(x), 42) for x in zip(*(w[k:] for k in range(shingle)), strict=False)]
    ones = np.zeros(BITS, np.int64)
    a = np.array(h, np.uint64)
    for k in range(0, len(a), 1 << 16):
        ones += np.unpackbits(a[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(a)).tobytes(), "big")


class _Fingerprints:
    def __init__(self, shingle):
        self.shingle = shingle

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            raw, at = data.tobytes(), off.tolist()
            out = np.fromiter((fingerprint(raw[i:j], self.shingle) for i, j in zip(at, at[1:], strict=False)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp as a signed long) of every row; null text counts as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_Fingerprints(shingle), "doc_id long, fp long")


def links(spark: SparkSession, fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) of distinct fingerprints fp that join exactly what differs in RADIUS bits or fewer, transitively.

    The ball hashing: of two fingerprints within RADIUS, some 64-bit value lies within NEAR of the one and FAR of the
    other, so each emits all its variants within FAR (those within NEAR are marked) and equal variants meet. As 2081
    variants of each don't fit a shuffle, the shuffle is on the variants' first bits: a fingerprint is sent once to each
    prefix that a variant of it has, and the variants with that prefix are made there. Where variants meet, everyone is
    linked to one marked member, never all pairs, and each link is verified; a task sends on one edge per fingerprint.
    Prefixes with very many fingerprints, found by counting, are split by SUB_BITS more bits over other tasks, and those
    that are still hot are split again.
    """
    n = fps.count()
    top = min(24, max(6, math.ceil(math.log2(max(1, n) / group)) if n > group else 6))
    hot_from, hot = max(40 * group, n // MOST_HOT), []
    for bits in range(top, BITS - SUB_BITS + 1, SUB_BITS):
        counted = fps.groupBy(F.shiftrightunsigned("fp", BITS - bits).alias("p")).count()
        found = [r.p for r in counted.where(F.col("count") > hot_from).select("p").collect()]
        if not found:
            break
        hot.append(np.sort(np.array(found, np.int64).view(np.uint64)))
    parts = max(spark.sparkContext.defaultParallelism, min(1 << top, math.ceil(n * _ball(top) / 200_000)))
    sent = fps.select("fp").mapInArrow(_Send(top, hot), "key long, bits int, fp long").repartition(parts, "key", "bits")
    meet = _Meet()
    return sent.groupBy("key", "bits").applyInArrow(lambda table: meet(table), "a long, b long").distinct()


def _ball(bits: int) -> int:
    return sum(math.comb(bits, k) for k in range(FAR + 1))


def _masks(bits: int, most: int) -> np.ndarray:
    return np.array([sum(1 << k for k in c) for r in range(most + 1) for c in combinations(range(bits), r)], np.uint64)


class _Send:
    """Each fingerprint to all prefixes within FAR of its own. hot: by how often they were split, the prefixes to split."""

    def __init__(self, top: int, hot: list[np.ndarray]):
        self.top, self.hot = top, hot

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(self.top, FAR)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            own = fp >> np.uint64(BITS - self.top)
            for m, u in zip(masks, np.bitwise_count(masks).tolist(), strict=True):
                key, bits, to = (np.concatenate(x) for x in zip(*self._split(fp, own ^ m, u, 0), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(bits), pa.array(to.view(np.int64))], names=["key", "bits", "fp"])

    def _split(self, fp: np.ndarray, key: np.ndarray, used: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(prefixes, their bits, fingerprints) of fingerprints sent to key, which is `used` bits off."""
        bits = self.top + times * SUB_BITS
        hot = np.isin(key, self.hot[times]) if times < len(self.hot) else np.zeros(len(key), bool)
        yield key[~hot], np.full((~hot).sum(), bits, np.int32), fp[~hot]
        if hot.any():
            fp, key = fp[hot], key[hot] << np.uint64(SUB_BITS)
            own = (fp >> np.uint64(BITS - bits - SUB_BITS)) & np.uint64((1 << SUB_BITS) - 1)
            for m in _masks(SUB_BITS, FAR - used):
                yield from self._split(fp, key | (own ^ m), used + int(np.bitwise_count(m)), times + 1)


class _Meet:
    def __call__(self, table: pa.Table) -> pa.Table:
        fp = np.sort(table.column("fp").to_numpy().view(np.uint64))
        value, fixed = table.column("key")[0].as_py() % (1 << BITS), table.column("bits")[0].as_py()
        root = np.arange(len(fp))
        for a, b in _meetings(fp, np.arange(len(fp)), fixed, value):
            root = _join(root, a, b)
        own = np.flatnonzero(root != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pa.table({"a": signed[own], "b": signed[root[own]]})


def _meetings(fp: np.ndarray, who: np.ndarray, fixed: int, value: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (as numbers in who) of fingerprints whose variants with the first `fixed` bits `value` meet."""
    low = BITS - fixed
    used = np.bitwise_count((fp >> np.uint64(low)) ^ np.uint64(value)).astype(np.int64)
    fp, who, used = fp[used <= FAR], who[used <= FAR], used[used <= FAR]
    if len(fp) < 2 or used.min() > NEAR:
        return
    size = sum(int((used == u).sum()) * sum(math.comb(low, k) for k in range(FAR - u + 1)) for u in range(FAR + 1))
    if size > AT_ONCE and low > 4:
        for x in range(16):
            yield from _meetings(fp, who, fixed + 4, value << 4 | x)
        return
    base = np.uint64(value << low) | (fp & np.uint64((1 << low) - 1))
    v, at, near = [], [], []
    for k in range(FAR + 1):
        masks = _masks_of(low, k)
        at_k = np.flatnonzero(used + k <= FAR)
        v.append((base[at_k, None] ^ masks[None, :]).ravel())
        at.append(np.repeat(at_k, len(masks)))
        near.append(np.repeat(used[at_k] + k <= NEAR, len(masks)))
    v, at, near = np.concatenate(v), np.concatenate(at), np.concatenate(near)
    order = np.argsort(v)
    v = v[order]
    same = v[1:] == v[:-1]
    some = np.concatenate((same, [False])) | np.concatenate(([False], same))
    order, v = order[some], v[some]
    if not len(v):
        return
    at, near = at[order], near[order]
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    center = np.minimum.reduceat(np.where(near, at, len(fp)), start)
    center = np.repeat(center, np.diff(np.concatenate((start, [len(v)]))))
    good = (center < len(fp)) & (center != at)
    pair = np.unique(center[good] * len(fp) + at[good])
    a, b = pair // len(fp), pair % len(fp)
    true = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
    yield who[a[true]], who[b[true]]


_MASKS: dict = {}


def _masks_of(bits: int, ones: int) -> np.ndarray:
    if (bits, ones) not in _MASKS:
        _MASKS[bits, ones] = np.array([sum(1 << k for k in c) for c in combinations(range(bits), ones)], np.uint64)
    return _MASKS[bits, ones]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component after adding links a-b; root holds it so far."""
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fp (signed long), component_id (the smallest doc_id reachable over links).

    Fingerprints that differ in RADIUS bits or fewer link; equal ones do, that of texts without words (0, null texts
    included) like any other. Texts are read whole. Copies are grouped to one fingerprint before any linking.
    Null doc_id: its row takes part; it is never a component_id unless the component has no other (then null).
    Repeated rows: each is returned. Empty table: no rows. Other columns are ignored.
    """
    bound_batches(spark)
    with scratch(spark) as keep:
        rows = materialize(spark, fingerprints(docs, doc_id, text, shingle), "fingerprints")
        fps = materialize(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        roots = connected_components(spark, links(spark, fps))
        many = materialize(spark, fps.join(roots, fps.fp == roots.node).select("fp", "first", "root"), "roots")
        least = materialize(spark, many.groupBy("root").agg(F.min("first").alias("component_id")), "least")
        own = many.join(least, "root").select("fp", "component_id")
        of = materialize(spark, fps.join(own, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "components")
        keep(rows, of)
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")
