"""Best-fit packing of token sequences, planned on a histogram of lengths."""

from __future__ import annotations

import math
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, materialize

CAPACITY = 2048
END = 0
"""Id that closes a document."""
KEPT_WORDS, KEPT_STRETCHES, KEPT_CHARS = 300_000, 60_000, 40
"""Words, and stretches between blanks, in a generation of those whose ids a worker remembers, and their longest; it affects
speed only."""
BUCKET_ROWS = 20_000
"""Pieces of one length that are numbered together."""

#: The letters, numbers and blanks among the characters that split() handles itself.
_LETTER = "a-zªµºß-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
_PLAIN = frozenset("\t\n\r" + "".join(map(chr, (*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x180)))))
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\t\\n\\r {_LETTER}{_NUMBER}]+")


def _byte_letters() -> list[str]:
    """The character that byte-level files write for each byte: itself if it prints, else one from U+0100 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(k if k in prints else next(others)) for k in range(256)]


_LETTERS = _byte_letters()


class _Kept(dict):
    """What make() gives for each key, found when first asked for. At so many keys a new generation begins; what is asked for
    again comes over from the last one, so frequent keys stay."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.last = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if (ids := self.last.get(key)) is None:
            ids = self.make(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.last = self.copy()
                self.clear()
            self[key] = ids
        return ids


class WordTokens:
    """Ids of the word-level BPE file by remembering the ids of words.

    The file lower-cases, closes up blanks and splits into words before merging, so the ids of a text are those of its
    words, and no word has a blank. Texts of plain Latin letters and ASCII are split here; any other text goes to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes_of = {k: struct.pack("<I", k) for k in self.tokenizer.get_vocab().values()}
        self.words = _Kept(self._word, KEPT_WORDS)
        self.stretches = _Kept(lambda x: b"".join([self.words[w] for w in _WORDS.findall(x)]), KEPT_STRETCHES)

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join([_LETTERS[b] for b in word.encode()])
        return b"".join([self.bytes_of[x.id] for x in self.model.tokenize(letters)])

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text or not _PLAIN.issuperset(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.stretches.__getitem__, text.lower().split())), "<u4")


@lru_cache(2)
def _tokens(path: str) -> WordTokens:
    """A worker's, for all its tasks."""
    return WordTokens(path)


class _Pieces:
    def __init__(self, path, capacity):
        self.path, self.capacity = path, capacity

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(self.path)
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(tokens.ids(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), self.capacity)):
                    part = ids[at : at + self.capacity]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids with END after them, cut at the capacity."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_Pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for so many items of each length: [(bins, [(length, times)])], all bins of an entry alike.

    Items above a third of the capacity come first, at most two to a bin: the longest left takes the longest that fits
    beside it. The others follow by falling length, each into the smallest gap that takes it, else into a new bin. It
    works on counts: as the smallest gap is chosen again until it is too small, bins of an entry fill one by one.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is outside 1 .. capacity")
    open_: dict[int, list[tuple[int, list]]] = {}
    gaps: list[int] = []

    def put(gap: int, bins: int, held: list) -> None:
        if bins:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((bins, held))

    def take(gap: int) -> tuple[int, list]:
        got = open_[gap].pop()
        if not open_[gap]:
            del open_[gap], gaps[bisect_left(gaps, gap)]
        return got

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1  # the longest that fits beside a
        if k < 0:
            put(capacity - a, left.pop(a), [(a, 1)])
            large.pop()
            continue
        b = large[k]
        pairs = left[a] // 2 if a == b else min(left[a], left[b])
        put(capacity - a - b, pairs, [(a, 2)] if a == b else [(a, 1), (b, 1)])
        for n in (a, b):
            left[n] -= pairs
        if a == b and left[a]:  # one is over; shorter ones may still fit it
            left[a] -= 1
            large.pop()
            if large:
                left[large[-1]] -= 1
                put(capacity - a - large[-1], 1, [(a, 1), (large[-1], 1)])
            else:
                put(capacity - a, 1, [(a, 1)])
        large = [n for n in large if left.get(n)]
        left = {n: c for n, c in left.items() if c}

    for n in sorted(left, reverse=True):
        c = left[n]
        while c:
            k = bisect_left(gaps, n)
            gap = gaps[k] if k < len(gaps) else capacity
            times = gap // n
            bins, held = take(gap) if k < len(gaps) else (math.ceil(c / times), [])
            full = min(bins, c // times)
            put(gap - times * n, full, [*held, (n, times)])
            c -= full * times
            rest = bins - full
            if rest and c:
                put(gap - c * n, 1, [*held, (n, c)])
                rest, c = rest - 1, 0
            if held:
                put(gap, rest, held)
    return [(bins, held) for gap in gaps for bins, held in open_[gap]]


def slots(bins: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, items to a bin, first bin, offset): where the items of that length go by rank."""
    out: dict[int, list] = {}
    at: dict[int, int] = {}
    base = 0
    for n_bins, held in bins:
        offset = 0
        for n, times in held:
            out.setdefault(n, []).append((at.get(n, 0), times, base, offset))
            at[n] = at.get(n, 0) + n_bins * times
            offset += n * times
        base += n_bins
    return {n: np.array(v, np.int64) for n, v in out.items()}


class _Place:
    def __init__(self, slots):
        self.slots = slots

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = self.slots.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                t = table[n]
                row = t[np.searchsorted(t[:, 0], rank[own], "right") - 1]
                nth = rank[own] - row[:, 0]
                seq[own] = row[:, 2] + nth // row[:, 1]
                off[own] = row[:, 3] + nth % row[:, 1] * n
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; sequences hold at most capacity ids.

    Pieces are counted by length, at most `capacity` counts, and plan() lays out the bins for all of them on the driver;
    the plan's size follows the capacity, not the data. Pieces then get ranks within their length, in hashed buckets of
    some BUCKET_ROWS rows with the buckets' counts added up, and take the place of their rank.

    Null text: empty, which packs as END alone. Null doc_id, repeated rows: each row is packed. Empty table: no rows.
    Other columns are ignored.
    """
    bound_batches(spark)
    pieces = materialize(spark, token_pieces(docs, tokenizer_path, capacity, doc_id, text), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if not counts:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    buckets = max(64, math.ceil(max(counts.values()) / BUCKET_ROWS))
    place = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(spark, sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "sums")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(within) - 1).join(sums.hint("merge"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).cast("long").alias("rank"))
    return ranked.mapInArrow(_Place(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
