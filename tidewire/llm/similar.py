"""Near-duplicate groups at a given Jaccard similarity of word shingles, for stages that keep one document of each.

At 0.8 fingerprints differ in some 6 to 14 of 64 bits, beyond any radius that ball hashing can reach, so the SimHash
links are joined by those of banded minima of the same shingles; every link is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash
from .common import bound_batches, broadcast_if_small, chunks, connected_components, materialize, scratch, utf8
from .suffix import _mix, _sums

BANDS, ROWS = 24, 6
"""Bands of minima, and minima in each: a pair at 0.8 shares a band but for 1 of 1,500, one at 0.9 but for 1 of 10**7."""
SMALL = 32
"""Members up to which a meeting compares everyone as rows; larger ones compare all with one, and in blocks who is left apart."""
BLOCK, MEMBERS = 1 << 19, 128
"""Shingles in a block of such a meeting, and members, at most on average."""
SURE = 0.17
"""Pairs whose estimate is this far below the threshold, five deviations at 0.8, aren't counted out exactly."""
CHUNK = 1 << 18
"""Bytes of text that a task works on at a time; a longer text stands alone."""
COLUMNS = 1 << 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")
_LOWER[list(b"\t\n\x0b\x0c\r")] = 32
_FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of each text, in order, repeats included, and where each text's begin. A text of fewer
    words has one shingle of all of them, one without words has none."""
    n = len(off) - 1
    text = np.full(len(data) + n + 1, 32, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(n) + 1, np.diff(off))] = _LOWER[data]
    begin = off[:-1] + np.arange(n)
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
    text, begin = text[keep], (np.cumsum(keep) - 1)[begin]
    word = np.flatnonzero((text[:-1] == 32) & (text[1:] != 32)) + 1 if len(text) > 1 else np.zeros(0, np.int64)
    end = np.flatnonzero((text[:-1] != 32) & (text[1:] == 32)) + 1 if len(text) > 1 else np.zeros(0, np.int64)
    first = np.searchsorted(word, begin + 1)
    words = np.diff(np.append(first, len(word)))
    count = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    at = np.cumsum(count) - count
    i = np.arange(count.sum()) + np.repeat(first - at, count)
    j = i + np.repeat(np.minimum(words, size), count) - 1
    p, inv = _sums(text)
    return _mix((p[end[j]] - p[word[i]]) * inv[word[i]] + (end[j] - word[i]).astype(np.uint64)), np.append(at, len(i))


class _Sketch:
    def __init__(self, size):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(_FACTORS)
        for b in batches:
            data, off = utf8(b.column("text"))
            sig, fp, count = np.zeros((b.num_rows, k), np.uint32), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64)
            for i, j in chunks(off, CHUNK):
                h, at = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], self.size)
                count[i:j] = np.diff(at)
                some = np.flatnonzero(count[i:j])
                if not len(some):
                    continue
                for f in range(k):
                    sig[i + some, f] = (np.minimum.reduceat(h * _FACTORS[f], at[some]) >> np.uint64(32)).astype(np.uint32)
                for x, y, row in zip(at[some], at[some + 1], i + some, strict=True):
                    ones = np.unpackbits(h[x:y].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                    fp[row] = np.packbits(ones * 2 > y - x).view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(fp.view(np.int64)), pa.array(count)], names=["node", "sig", "fp", "n"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node = b.column("node").to_numpy()
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(len(node), BANDS, ROWS)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(node), axis=0)
        for r in range(ROWS):
            key = _mix(key * np.uint64(31) + sig[:, :, r])
        band = np.tile(np.arange(BANDS, dtype=np.int32), len(node))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(node, BANDS)), pa.array(band)], names=["key", "node", "band"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x == y).mean(axis=1))], names=["a", "b", "j"])


class _Sets:
    def __init__(self, size):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            out = []
            for i, j in chunks(off, CHUNK):
                h, at = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i], self.size)
                out += [np.unique(h[x:y]).tobytes() for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(out, pa.binary())], names=["node", "set"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        j = []
        for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            j.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(j, pa.float64())], names=["a", "b", "j"])


def _joined(similarity):
    """Of the members of one or two blocks (root, set), links between roots that join all roots with alike members."""

    def joined(t: pa.Table) -> pa.Table:
        root = t.column("root").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
        size = np.array([len(s) for s in sets])
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[code] > 1
        who, col = np.repeat(np.arange(len(root)), size)[shared], (np.cumsum(count > 1) - 1)[code[shared]]
        order = np.argsort(col, kind="stable")
        who, col = who[order], col[order]
        both = np.zeros((len(root), len(root)))
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
            i, j = np.searchsorted(col, (lo, lo + COLUMNS))
            has = np.zeros((len(root), COLUMNS), np.float32)
            has[who[i:j], col[i:j] - lo] = 1
            both += has @ has.T
        alike = both / np.maximum(1, size[:, None] + size[None, :] - both) >= similarity
        up = {r: r for r in root.tolist()}

        def top(r):
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        out = []
        for i, j in zip(*np.nonzero(np.triu(alike & (root[:, None] != root[None, :]), 1)), strict=True):
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append((min(x, y), max(x, y)))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return joined


def _beside(edges: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """edges (a, b) with the value of either end."""
    for end in "ab":
        edges = edges.join(values.select(F.col("node").alias(end), F.col(name).alias(f"{name}_{end}")), end)
    return edges.select("a", "b", f"{name}_a", f"{name}_b")


def similar_groups(spark: SparkSession, rows: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, root) of every row of rows (node long, unique; text) with a near duplicate; root is the group's least node.

    Candidates meet in SimHash balls and in bands of minima. A meeting of up to SMALL compares everyone. A larger one first
    compares all with the member that meets most others, which joins most of a group of copies; then all pairs of its members
    that nothing has joined yet are counted out, in blocks. An estimate from the minima dismisses pairs that are SURE below
    the threshold; the shingle sets decide all others. Texts without words: no group. Null text: empty.
    """
    bound_batches(spark)
    with scratch(spark) as keep:
        sketch = materialize(spark, rows.select("node", "text").mapInArrow(_Sketch(shingle), "node long, sig binary, fp long, n long").where("n > 0"), "sketch")
        bands = materialize(spark, sketch.select("node", "sig").mapInArrow(_bands, "key long, node long, band int").select("key", "node"), "bands")
        fps = materialize(spark, sketch.groupBy("fp").agg(F.min("node").alias("node")), "fps")
        by = fps.select(F.col("fp"), F.col("node").alias("n2"))
        ball = simhash.links(spark, fps).join(by.withColumnRenamed("fp", "a").withColumnRenamed("n2", "x"), "a").join(by.withColumnRenamed("fp", "b").withColumnRenamed("n2", "y"), "b")
        same = sketch.select("node", "fp").join(fps.select("fp", F.col("node").alias("x")), "fp").where("node != x")
        edges = ball.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same.select(F.col("x").alias("a"), F.col("node").alias("b")))
        sizes = materialize(spark, bands.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
        few = bands.join(sizes.where(F.col("c") <= SMALL).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))
        beside = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        large = materialize(spark, bands.join(sizes.where(F.col("c") > SMALL), "key"), "large")
        often = materialize(spark, large.groupBy("node").agg(F.sum("c").alias("often")), "often")
        center = large.join(often, "node").groupBy("key").agg(F.max_by("node", F.struct("often", -F.col("node"))).alias("a"))
        many = large.join(materialize(spark, center, "center"), "key").where("node != a").select(F.least("a", "node"), F.greatest("a", "node"))
        edges = materialize(spark, edges.union(few.select(F.inline(beside))).union(many).distinct(), "edges")
        checked = materialize(spark, _check(spark, rows, sketch, edges, shingle, similarity), "checked")
        alike = checked.where("alike").select("a", "b")
        groups = materialize(spark, connected_components(spark, alike), "groups")
        more = _crowds(spark, rows, sketch, large.select("key", "node"), groups, shingle, similarity)
        if more is not None:
            merged = materialize(spark, connected_components(spark, more), "merged")
            tops = broadcast_if_small(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), merged.count(), 16)
            moved = groups.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            groups = materialize(spark, moved.union(merged.join(groups, "node", "left_anti").select("node", "root")), "groups")
        keep(groups)
    return groups


def _crowds(spark, rows, sketch, large, groups, shingle, similarity) -> DataFrame | None:
    """Links (a, b) between roots, a node of no group being its own, enough to join all alike members of each meeting
    (key, node) that groups leaves apart, None if there are none.

    Members of one group needn't be compared, so a group too large for a block has blocks of its own, which meet those of
    the others only; smaller ones share blocks. Every pair of blocks is one task of bounded size.
    """
    of = materialize(spark, large.join(groups, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "members")
    apart = materialize(spark, of.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key"), "apart")
    if apart.isEmpty():
        return None
    weight = F.greatest("n", F.lit(BLOCK // MEMBERS))
    of = materialize(spark, of.join(broadcast_if_small(apart, apart.count(), 16), "key").join(sketch.select("node", weight.alias("w")), "node"), "apart_members")
    parts = materialize(spark, of.groupBy("key", "root").agg(F.sum("w").alias("of_root")), "parts")
    rest = parts.groupBy("key").agg(F.sum(F.when(F.col("of_root") <= BLOCK, F.col("of_root"))).alias("rest"))
    parts = materialize(spark, parts.join(rest, "key").withColumn("alone", F.col("of_root") > BLOCK), "parts_rest")
    deal = lambda c, total: F.pmod(F.xxhash64(c), F.ceil(F.col(total) / BLOCK))
    block = F.when(F.col("alone"), F.xxhash64("root", deal("node", "of_root"))).otherwise(deal("root", "rest"))
    of = of.join(parts, ["key", "root"]).select("key", "node", "root", F.when(F.col("alone"), F.col("root")).alias("own"), block.alias("block"))
    of = materialize(spark, of, "blocks")
    x = materialize(spark, of.select("key", "block", "own").distinct(), "block_keys")
    y = x.select("key", F.col("block").alias("block2"), F.col("own").alias("own2"))
    pairs = x.join(y, "key").where("block <= block2 and coalesce(own != own2, true)").withColumn("pair", F.xxhash64("key", "block", "block2"))
    sides = pairs.select("key", "pair", F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    nodes = materialize(spark, of.select("node").distinct(), "ends")
    dealt = of.select("key", "block", "node", "root").join(materialize(spark, sides, "sides"), ["key", "block"]).select("pair", "node", "root")
    full = dealt.join(_sets(spark, rows, nodes, shingle), "node").select("pair", "root", "set")
    more = materialize(spark, full.groupBy("pair").applyInArrow(_joined(similarity), "a long, b long").distinct(), "more")
    return None if more.isEmpty() else more


def _sets(spark, rows, nodes, shingle) -> DataFrame:
    """(node, set) of nodes: the sorted hashes of all shingles."""
    sets = rows.select("node", "text").join(broadcast_if_small(nodes, nodes.count(), 16), "node", "left_semi").mapInArrow(_Sets(shingle), "node long, set binary")
    return materialize(spark, sets, "sets")


def _check(spark, rows, sketch, edges, shingle, similarity) -> DataFrame:
    """edges (a, b) with alike: whether the similarity is reached."""
    rated = materialize(spark, _beside(edges, sketch, "sig").mapInArrow(_estimate, "a long, b long, j double"), "rated")
    clear = F.col("j") <= similarity - SURE
    near = materialize(spark, rated.where(~clear).select("a", "b"), "near")
    ends = materialize(spark, near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), "ends")
    exact = _beside(near, _sets(spark, rows, ends, shingle), "set").mapInArrow(_exact, "a long, b long, j double")
    return rated.where(clear).union(exact).select("a", "b", (F.col("j") >= similarity).alias("alike"))
