"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, bound_batches, chunks, materialize, utf8
from .suffix import _mix, _sums

WINDOW = 10
BLOCK_BYTES = BROADCAST_LIMIT
"""Bytes of the tables in one broadcast block; a benchmark that needs more is searched in several blocks. An item whose tables
are larger stands alone."""
HELD_BYTES = 64 << 20
"""Bytes of tables that a Python worker holds; between so many the state of the search is written."""
MOST_PREFIX = 256
MOST_BITS = 21
"""Of a shift table, with two bytes an entry."""
CHUNK = 1 << 19

#: Lower-cased word bytes, and a blank for every other ASCII byte.
_MAP = np.arange(256, dtype=np.uint8)
_MAP[:128] = 32
for _r in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
    _MAP[list(_r)] = list(_r)
_MAP[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = list(b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    return _MAP[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


def _windows(items: list[tuple[str, str | None]], number: dict[str, int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items as ` word word ... ` end to end, and of all their windows the start, length, words and item."""
    bodies, found, at = [], [(np.zeros(0, np.int64),) * 4], 0
    for item, text in items:
        w = words(text)
        if w:
            body = b" " + b" ".join(w) + b" "
            blank = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
            size = min(len(w), WINDOW)
            begin, end = blank[: len(w) - size + 1], blank[size:] + 1
            found.append((begin + at, end - begin, np.full(len(begin), size), np.full(len(begin), number[item])))
            bodies.append(body)
            at += len(body)
    return b"".join(bodies), *(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


class WuManber:
    """Finds patterns, each ` word word ... ` with a blank at both ends, in texts of the same form.

    A pattern is a place in the items' text, which is held once; windows with the same bytes are one pattern. Patterns are
    dealt into classes by length, so that a short one doesn't shorten every shift. In a class all patterns are taken by their
    first m bytes (m: the least length, or MOST_PREFIX). shift[block hash] is how far a window may move when it ends in that
    block; blocks that end a prefix have shift 0 and lead to the patterns to compare, byte by byte.
    """

    def __init__(self, items: list[tuple[str, str | None]]):
        self.names = sorted({i for i, _ in items})
        self.body, start, length, n_words, owner = _windows(items, {x: k for k, x in enumerate(self.names)})
        text = np.frombuffer(self.body, np.uint8)
        p, inv = _sums(text)
        h = _mix((p[start + length] - p[start]) * inv[start] + length.astype(np.uint64))
        order = np.argsort(h, kind="stable")
        first = np.concatenate(([True], h[order][1:] != h[order][:-1])) if len(h) else np.zeros(0, bool)
        of = np.empty(len(h), np.int64)
        of[order] = order[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else 0
        own: dict[bytes, int] = {}
        for k in np.flatnonzero(of != np.arange(len(h))).tolist():  # equal hashes of different bytes stay apart
            a, b = (self.body[start[x] : start[x] + length[x]] for x in (k, of[k]))
            if a != b:
                of[k] = own.setdefault(a, k)
        kept, number = np.unique(of, return_inverse=True)
        self.start, self.length, self.n_words = start[kept], length[kept].astype(np.int32), n_words[kept].astype(np.uint8)
        pairs = np.unique(np.stack((number.ravel(), owner)), axis=1)
        self.item = pairs[1].astype(np.int32)
        self.item_at = np.searchsorted(pairs[0], np.arange(len(kept) + 1)).astype(np.int32)
        size = np.floor(np.log2(self.length)).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
        self.classes = [self._class(text, np.flatnonzero(size == k)) for k in np.unique(size)]

    def _class(self, text: np.ndarray, ids: np.ndarray) -> tuple:
        m = min(MOST_PREFIX, int(self.length[ids].min()))
        block = max(2, min(8, m // 3))
        bits = max(12, min(MOST_BITS, int(np.ceil(np.log2(len(ids) * m + 1))) + 2))
        shift = np.full(1 << bits, m - block + 1, np.uint16)
        for end in range(block, m + 1):
            np.minimum.at(shift, _hash(_value(text, self.start[ids] + end, block), bits), m - end)
        value = _value(text, self.start[ids] + m, block)
        order = np.argsort(value, kind="stable")
        keys, at = np.unique(value[order], return_index=True)
        return m, block, bits, shift, keys, np.append(at, len(ids)).astype(np.int32), ids[order].astype(np.int32)

    @property
    def bytes(self) -> int:
        """Of all tables."""
        own = (self.start, self.length, self.n_words, self.item, self.item_at, *(x for c in self.classes for x in c[3:]))
        return len(self.body) + sum(x.nbytes for x in own) + sum(map(len, self.names))

    def items_of(self, pattern: int) -> list[str]:
        return [self.names[k] for k in self.item[self.item_at[pattern] : self.item_at[pattern + 1]].tolist()]

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, pattern) of every occurrence in the bytes of text, which may hold many documents."""
        whole = text.tobytes()
        for m, block, bits, shift, keys, at_key, ids in self.classes:
            stride = m - block + 1
            at = np.arange(m, len(text) + 1, stride, dtype=np.int64)  # where windows end
            to = np.minimum(at + stride, len(text) + 1)  # the next one takes over from there
            while len(at):
                value = _value(text, at, block)
                s = shift[_hash(value, bits)].astype(np.int64)
                end, value = at[s == 0], value[s == 0]
                key = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                known = keys[key] == value
                for e, k in zip(end[known].tolist(), key[known].tolist(), strict=True):
                    for q in ids[at_key[k] : at_key[k + 1]].tolist():
                        i, n = int(self.start[q]), int(self.length[q])
                        if whole.startswith(self.body[i : i + n], e - m):
                            yield e - m, q
                at = at + np.maximum(s, 1)
                on = at < to
                at, to = at[on], to[on]


def _value(text: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    """The `block` bytes, eight at most, before each end, as a number."""
    v = np.zeros(len(end), np.uint64)
    for k in range(1, block + 1):
        v = (v << np.uint64(8)) | text[end - k].astype(np.uint64)
    return v


def _hash(value: np.ndarray, bits: int) -> np.ndarray:
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts as ` word word ` each after a separator byte that no word has, with runs of blanks closed up; and where each begins."""
    n = len(off) - 1
    out = np.full(len(data) + 3 * n + 1, 32, np.uint8)
    place = np.arange(len(data)) + np.repeat(3 * np.arange(n) + 2, np.diff(off))
    out[place] = _MAP[data]
    begin = off[:-1] + 3 * np.arange(n)
    out[begin] = 10
    out[-1] = 10
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep], (np.cumsum(keep) - keep)[begin]


def mark(matcher: WuManber, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, set, np.ndarray]]]:
    """Words in each text; and for each text with occurrences its number, the items, and a flag for each of its words."""
    text, begin = _normal(data, off)
    start = (text[:-1] == 32) & (text[1:] != 32) & (text[1:] != 10)  # the blank before each word
    before = np.concatenate(([0], np.cumsum(start)))
    first = before[begin]
    n_words = np.diff(np.concatenate((first, before[-1:])))
    by: dict[int, list[tuple[int, int]]] = {}
    for at, k in matcher.search(text):
        by.setdefault(int(np.searchsorted(begin, at, "right")) - 1, []).append((int(before[at]), k))
    found = []
    for d, hits in by.items():
        flag, items = np.zeros(int(n_words[d]), bool), set()
        for w, k in hits:
            flag[w - first[d] : w - first[d] + int(matcher.n_words[k])] = True
            items.update(matcher.items_of(k))
        found.append((d, items, flag))
    return n_words, found


def decontaminate(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, clean: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted list of item ids as strings), contaminated.

    clean: instead, the rows of docs that aren't contaminated, with all their columns.
    The benchmark is read in blocks whose tables take block_bytes at most; these are broadcast, and every text passes the
    blocks one after the other in one stage without a shuffle, gathering a flag for each of its words. Only where the blocks
    together take over HELD_BYTES is the state written in between. Null texts and texts without words: no words, not contaminated. A benchmark without
    patterns: nothing is hit. Items without an id count under the id "". Repeated items count once. Null doc_ids,
    repeated rows and other columns: kept as they are.
    """
    bound_batches(spark)
    blocks = _blocks(spark, benchmark, item_id, item_text, block_bytes)
    ids = docs.schema.names if clean else [doc_id]
    inner = [f"c{k}" for k in range(len(ids))]
    kinds = [docs.schema[c].dataType for c in ids]
    now = docs.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(ids, inner, strict=True)],
        F.col(f"`{text}`").alias("body"),
        F.expr("cast(null as binary)").alias("flags"),
        F.expr("cast(array() as array<string>)").alias("items"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_hit"),
    )
    for k, group in enumerate(blocks):
        now = materialize(spark, now, "searched") if k else now
        now = now.mapInArrow(_Pass(group), now.schema)
    if clean:
        return now.where("n_hit = 0").select(*[F.col(i).cast(t).alias(c) for c, i, t in zip(ids, inner, kinds, strict=True)])
    return now.select(F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def _blocks(spark, benchmark, item_id, item_text, block_bytes):
    """Groups of broadcast matchers, HELD_BYTES each. The driver holds one block of the benchmark at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    out, size = [[]], 0

    def add(held: list) -> None:
        """The matcher of these items, or of either half of them if it is too large."""
        nonlocal size
        matcher = WuManber(held)
        if matcher.bytes > block_bytes and len(held) > 1:
            add(held[: len(held) // 2])
            add(held[len(held) // 2 :])
            return
        if out[-1] and size + matcher.bytes > HELD_BYTES:
            out.append([])
            size = 0
        out[-1].append(spark.sparkContext.broadcast(matcher))
        size += matcher.bytes

    held, chars = [], 0
    for r in rows.toLocalIterator():
        held.append((r.i, r.t))
        chars += len(r.t)
        if chars >= block_bytes // 4:
            add(held)
            held, chars = [], 0
    if held or not out[0]:
        add(held)
    return out


class _Pass:
    def __init__(self, matchers):
        self.matchers = matchers

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("body"))
            flags, items = b.column("flags").to_pylist(), b.column("items").to_pylist()
            count, hit = np.zeros(b.num_rows, np.int64), b.column("n_hit").to_numpy().copy()
            for matcher in self.matchers:
                for i, j in chunks(off, CHUNK):
                    n, found = mark(matcher.value, data[off[i] : off[j]], off[i : j + 1] - off[i])
                    count[i:j] = n
                    for d, names, flag in found:
                        had = flags[i + d]
                        flag = flag | np.frombuffer(had, bool) if had else flag
                        flags[i + d], hit[i + d] = flag.tobytes(), flag.sum()
                        items[i + d] = sorted(names.union(items[i + d]))
            new = {"n_hit": pa.array(hit), "flags": pa.array(flags, b.schema.field("flags").type), "items": pa.array(items, b.schema.field("items").type), "n_words": pa.array(count)}
            yield pa.RecordBatch.from_arrays([new.get(f.name, b.column(k)) for k, f in enumerate(b.schema)], names=b.schema.names)
