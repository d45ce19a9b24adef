"""Repeated substrings by bucket-pointer refinement of sampled suffixes, in partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, chunks, materialize, utf8

LENGTH = 100
"""Bytes of a repeated string."""
Q = 32
"""Bytes of the q-grams that make the first buckets."""
STEP = LENGTH // 4
"""Bytes of the q-grams within a bucket, and the first later offset."""
PART_BYTES = 8 << 20
"""Bytes of text aimed at for a partition of the exchanges."""
CHUNK = 1 << 19
"""Bytes of text, and of strings of open buckets, that a task works on at a time; a longer text or bucket stands alone."""
BATCH = 8 << 20
"""Bytes of text whose equal runs meet before the first exchange."""
SAMPLE = 10_000
"""Documents looked at to find q-grams so frequent that their bucket is split; results don't depend on it."""
HOT_SHARE = 0.01
MOST_HOT = 10_000

_W = LENGTH - Q + 1
_POS = np.uint64((1 << 24) - 1)
_MULT = 0x9E3779B97F4A7C15
_NONE = -(1 << 63)
BLOCK = "part int, kind int, h binary, u binary, d binary, t binary, l binary, w binary, x binary"
ANCHOR, GONE, OPEN, OPEN_HOT, TEXT, STRINGS, WINDOWS = range(7)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums P and inverse powers I, so that (P[b] - P[a]) * I[a] is a hash of data[a:b]."""
    n = len(data)
    powers = _powers
    if len(powers[0]) < n + 1:
        powers = []
        for base in (_MULT, pow(_MULT, -1, 1 << 64)):
            full = np.full(max(n, CHUNK) + 1, base, np.uint64)
            full[0] = 1
            powers.append(np.multiply.accumulate(full, out=full))
        if n <= 2 * CHUNK:  # those of a long text are for it alone
            _powers[:] = powers
    p = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[0][:n], out=p[1:])
    return p, powers[1]


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every start of LENGTH bytes in each text, in runs that share an anchor: (text, first, last start, bucket, content).

    The anchor of a start is where the least hash of a Q-byte q-gram within its LENGTH bytes lies, so equal strings have
    equal anchors at equal places. bucket is that q-gram's hash, content a hash of all bytes that the run covers.
    """
    lens = np.maximum(np.diff(off) - (LENGTH - 1), 0)
    total = int(lens.sum())
    if not total:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) > 1 << 23:  # one very long text: in overlapping parts
        half = len(data) // 2
        a = spans(data[: half + LENGTH - 1], np.array([0, half + LENGTH - 1]))
        b = spans(data[half:], np.array([0, len(data) - half]))
        return tuple(np.concatenate((x, y + half if k in (1, 2) else y)) for k, (x, y) in enumerate(zip(a, b, strict=True)))
    p, inv = _sums(data)
    gram = _mix((p[Q:] - p[:-Q]) * inv[: len(data) - Q + 1])
    least = (gram & ~_POS) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= _W:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (_W - width)], least[_W - width :])
    s = np.arange(total) + np.repeat(off[:-1] - (np.cumsum(lens) - lens), lens)
    text = np.repeat(np.arange(len(lens)), lens)
    anchor = (least[s] & _POS).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
    end = np.append(begin[1:], total) - 1
    first, last = s[begin], s[end]
    bucket = gram[anchor[begin]] & ~np.uint64(0xFFFF)
    content = _mix((p[last + LENGTH] - p[first]) * inv[first] + (last - first).astype(np.uint64))
    return text[begin], first, last, bucket, content


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes, those of equal rank together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _plain(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


_KINDS = {"h": np.uint64, "u": np.uint64, "d": np.int64, "t": np.int64, "l": np.uint32, "w": np.uint16}


def _blocks(kind: int, part: np.ndarray, **cols: np.ndarray) -> Iterator[dict]:
    """A row for each part with its share of the columns."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    if not len(part):
        return
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    cols = {k: np.asarray(v, _KINDS[k])[order] for k, v in cols.items()}
    for i, j in zip(cuts, np.append(cuts[1:], len(part)), strict=True):
        yield {"part": int(part[i]), "kind": kind, **{k: _planes(v[i:j]) for k, v in cols.items()}}


def _batch(rows: list[dict]) -> dict:
    kinds = {"part": pa.int32(), "kind": pa.int32()}
    names = ["part", "kind", *_KINDS, "x"]
    return {n: pa.array([r.get(n) for r in rows], kinds.get(n, pa.binary())) for n in names}


def _read(table: pa.Table, *kinds: int) -> dict[str, np.ndarray]:
    """The columns of all blocks of these kinds, joined."""
    rows = [r for r in table.select(["kind", *_KINDS]).to_pylist() if r["kind"] in kinds]
    return {k: np.concatenate([_plain(r[k], t) if r[k] is not None else np.zeros(0, t) for r in rows] or [np.zeros(0, t)]) for k, t in _KINDS.items()}


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(x.astype(np.uint64) + np.uint64(1)) >> np.uint64(40)).astype(np.int64) % parts


def _later(order: np.ndarray, same: np.ndarray, d: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of things sorted by class, d, t and start: whether an equal one starts earlier (same[i]: as the one before it)."""
    d, t = d[order], t[order]
    begin = np.flatnonzero(~same)
    least = np.repeat(d[begin], np.diff(np.append(begin, len(d))))
    again = same.copy()
    again[1:] &= (d[1:] == d[:-1]) & (t[1:] == t[:-1])
    out = np.empty(len(d), bool)
    out[order] = (d > least) | again
    return out


def _classes(*keys: np.ndarray) -> np.ndarray:
    same = np.zeros(len(keys[0]), bool)
    if len(same) > 1:
        same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in keys])
    return same


class _Anchors:
    """Texts to blocks of runs for their buckets; of equal runs in a batch only the earliest goes on."""

    def __init__(self, parts, hot):
        self.parts, self.hot = parts, hot

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            doc, key = b.column("d").to_numpy(), b.column("t").to_numpy()
            for i, j in chunks(off, BATCH):
                yield pa.RecordBatch.from_pydict(_batch(self._rows(data[off[i] : off[j]], off[i : j + 1] - off[i], doc[i:j], key[i:j])))

    def _rows(self, data: np.ndarray, off: np.ndarray, doc: np.ndarray, key: np.ndarray) -> list[dict]:
        got = []
        for i, j in chunks(off, CHUNK):
            text, first, last, h, u = spans(data[off[i] : off[j]], off[i : j + 1] - off[i])
            got.append((text + i, first + off[i] - off[text + i], last - first, h, u))
        text, first, width, h, u = (np.concatenate(x) for x in zip(*got, strict=True))
        d, t = doc[text], key[text]
        order = np.lexsort((first, t, d, u, h))
        gone = _later(order, _classes(h[order], u[order]), d, t)
        rows = list(_blocks(GONE, _part(d[gone], self.parts), d=d[gone], t=t[gone], l=first[gone], w=width[gone]))
        on = ~gone
        to = np.where(np.isin(h[on], self.hot), h[on] ^ u[on], h[on])
        return [*rows, *_blocks(ANCHOR, _part(to, self.parts), h=h[on], u=u[on], d=d[on], t=t[on], l=first[on], w=width[on])]


class _Refine:
    """Bucket by bucket: of runs with equal content the earliest stays; buckets with several contents stay open."""

    def __init__(self, parts, hot):
        self.parts, self.hot = parts, hot

    def __call__(self, table: pa.Table) -> pa.Table:
        g, a = _read(table, GONE), _read(table, ANCHOR)
        h, u, d, t = a["h"], a["u"], a["d"], a["t"]
        order = np.lexsort((a["l"], t, d, u, h))
        same = _classes(h[order], u[order])
        gone = _later(order, same, d, t)
        bucket = ~_classes(h[order])
        number = np.cumsum(bucket) - 1
        contents = np.bincount(number, weights=~same, minlength=1) if len(number) else np.zeros(1)
        hot = np.isin(h, self.hot)
        several = np.empty(len(h), bool)
        several[order] = contents[number] > 1
        open_ = ~gone & (several | hot)
        rows = list(_blocks(GONE, _part(g["d"], self.parts), **{k: g[k] for k in "dtlw"}))
        for kind, m in ((GONE, gone), (OPEN, open_ & ~hot), (OPEN_HOT, open_ & hot)):
            rows += _blocks(kind, _part(d[m], self.parts), **{k: a[k][m] for k in ("dtlw" if kind == GONE else "hdtlw")})
        return pa.Table.from_pydict(_batch(rows))


class _Texts:
    """Texts to blocks by document, compressed together."""

    def __init__(self, parts):
        self.parts = parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            d, t = b.column("d").to_numpy(), b.column("t").to_numpy()
            part, raw, at = _part(d, self.parts), data.tobytes(), off.tolist()
            rows = []
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                body = b"".join([raw[at[k] : at[k + 1]] for k in own.tolist()])
                rows.append({"part": p, "kind": TEXT, "d": _planes(d[own]), "t": _planes(t[own]), "l": _planes((off[own + 1] - off[own]).astype(np.uint32)), "x": zstandard.ZstdCompressor(level=3).compress(body)})
            yield pa.RecordBatch.from_pydict(_batch(rows))


def _documents(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    for r in table.select(["d", "t", "l", "x"]).to_pylist():
        body, at = zstandard.ZstdDecompressor().decompress(r["x"]), 0
        for d, t, n in zip(_plain(r["d"], np.int64).tolist(), _plain(r["t"], np.int64).tolist(), _plain(r["l"], np.uint32).tolist(), strict=True):
            yield d, t, body[at : at + n]
            at += n


def _by_row(a: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Numbers of a's entries by document row."""
    order = np.lexsort((a["l"], a["t"], a["d"]))
    same = _classes(a["d"][order], a["t"][order])
    begin = np.flatnonzero(~same)
    if not len(order):
        return {}
    return {(int(a["d"][order[i]]), int(a["t"][order[i]])): order[i:j] for i, j in zip(begin, np.append(begin[1:], len(order)), strict=True)}


class _Contents:
    """The bytes of open runs, for their buckets. Runs of hot buckets go as hashes of their strings, each on its own."""

    def __init__(self, parts):
        self.parts = parts

    def __call__(self, texts: pa.Table, runs: pa.Table) -> pa.Table:
        rows: list[dict] = []
        cold, hot = _read(runs, OPEN), _read(runs, OPEN_HOT)
        by_cold, by_hot = _by_row(cold), _by_row(hot)
        order, bodies, seen = [], [], set()
        wide: list[tuple] = []
        for d, t, body in _documents(texts):
            if (d, t) in seen:  # a repeated row
                continue
            seen.add((d, t))
            for k in by_cold.get((d, t), ()):
                i = int(cold["l"][k])
                order.append(k)
                bodies.append(body[i : i + int(cold["w"][k]) + LENGTH])
            for k in by_hot.get((d, t), ()):
                i, n = int(hot["l"][k]), int(hot["w"][k])
                p, inv = _sums(np.frombuffer(body[i : i + n + LENGTH], np.uint8))
                wide.append((d, t, i, n, (p[LENGTH:] - p[: n + 1]) * inv[: n + 1], hot["h"][k]))
        order = np.array(order, np.int64)
        part = _part(cold["h"][order], self.parts)
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            body = zstandard.ZstdCompressor(level=3).compress(b"".join([bodies[k] for k in own.tolist()]))
            rows.append({"part": p, "kind": STRINGS, "x": body, **{k: _planes(cold[k][order[own]]) for k in "hdtlw"}})
        if wide:
            n = np.array([w[3] + 1 for w in wide])
            d, t, l = (np.repeat(np.array([w[k] for w in wide], np.int64), n) for k in range(3))
            l = l + np.concatenate([np.arange(k) for k in n])
            h, u = _mix(np.concatenate([w[4] for w in wide])), np.repeat(np.array([w[5] for w in wide], np.uint64), n)
            rank = np.lexsort((l, t, d, u, h))
            gone = _later(rank, _classes(h[rank], u[rank]), d, t)
            one = np.zeros(len(d), np.uint16)
            rows += _blocks(GONE, _part(d[gone], self.parts), d=d[gone], t=t[gone], l=l[gone], w=one[gone])
            on = ~gone
            rows += _blocks(WINDOWS, _part(h[on], self.parts), h=h[on], u=u[on], d=d[on], t=t[on], l=l[on], w=one[on])
        return pa.Table.from_pydict(_batch(rows))


def refine(body: np.ndarray, begin: np.ndarray, width: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of LENGTH bytes that occur twice in one bucket: (run, start in it, class), equal classes for equal strings.

    Run k is the bytes of body from begin[k], width[k] + LENGTH of them. The first buckets are of STEP-byte q-grams;
    pointers of twice the length come from sorting on the pointers at the later offset, and are used again for the
    next length. What is alone in its bucket is left out of the next sort.
    """
    p, inv = _sums(body)
    gram = _mix((p[STEP:] - p[:-STEP]) * inv[: len(body) - STEP + 1])
    run = np.repeat(np.arange(len(begin)), width + LENGTH - STEP + 1)
    at = np.arange(len(run)) - np.repeat(np.cumsum(width + LENGTH - STEP + 1) - (width + LENGTH - STEP + 1), width + LENGTH - STEP + 1)
    pointer = np.zeros(len(body) + 1, np.int64)  # 0: alone
    where = begin[run] + at
    key = gram[where] ^ _mix(bucket[run] + np.uint64(7))
    size = STEP
    while True:
        order = np.argsort(key)
        same = _classes(key[order])
        many = same | np.append(same[1:], False)
        number = np.cumsum(~same)
        pointer[:] = 0
        pointer[where[order]] = np.where(many, number, 0)
        if size == LENGTH:
            break
        live = (pointer[where] > 0) & (at + 2 * size <= width[run] + LENGTH)
        run, at, where = run[live], at[live], where[live]
        late = pointer[where + size]
        run, at, where, late = run[late > 0], at[late > 0], where[late > 0], late[late > 0]
        key = pointer[where] * np.int64(len(body) + 1) + late
        size *= 2
    here = pointer[where]
    keep = here > 0
    return run[keep], at[keep], here[keep]


class _Settle:
    """Open buckets: strings that start earlier elsewhere make later ones go."""

    def __init__(self, parts):
        self.parts = parts

    def __call__(self, table: pa.Table) -> pa.Table:
        rows: list[dict] = []
        for r in table.select(["kind", "part", *_KINDS, "x"]).to_pylist():
            if r["kind"] == GONE:
                rows.append(r)
        w = _read(table, WINDOWS)
        order = np.lexsort((w["l"], w["t"], w["d"], w["u"], w["h"]))
        gone = _later(order, _classes(w["h"][order], w["u"][order]), w["d"], w["t"])
        rows += self._runs(w["d"][gone], w["t"][gone], w["l"][gone])
        for part in self._strings(table):
            rows += part
        return pa.Table.from_pydict(_batch(rows))

    def _strings(self, table: pa.Table) -> Iterator[list[dict]]:
        """By runs of whole buckets."""
        a = _read(table, STRINGS)
        bodies = [zstandard.ZstdDecompressor().decompress(r["x"]) for r in table.select(["kind", "x"]).to_pylist() if r["kind"] == STRINGS]
        whole = np.frombuffer(b"".join(bodies), np.uint8)
        size = a["w"].astype(np.int64) + LENGTH
        begin = np.cumsum(size) - size
        by = np.argsort(a["h"], kind="stable")
        ends = np.flatnonzero(np.append(~_classes(a["h"][by])[1:], True)) + 1 if len(by) else by
        before = np.concatenate(([0], np.cumsum(size[by])[ends - 1])) if len(by) else np.zeros(1, np.int64)
        for i, j in chunks(before, CHUNK):
            own = by[(ends[i - 1] if i else 0) : ends[j - 1]]
            body = np.concatenate([whole[x : x + n] for x, n in zip(begin[own].tolist(), size[own].tolist(), strict=True)])
            at_own = np.cumsum(size[own]) - size[own]
            run, at, name = refine(body, at_own, a["w"][own].astype(np.int64), a["h"][own])
            d, t, l = a["d"][own][run], a["t"][own][run], a["l"][own][run].astype(np.int64) + at
            order = np.lexsort((l, t, d, name))
            same = _classes(name[order])
            _verify(body, (at_own[run] + at)[order], same)
            gone = _later(order, same, d, t)
            yield list(self._runs(d[gone], t[gone], l[gone]))

    def _runs(self, d, t, l):
        order = np.lexsort((l, t, d))
        d, t, l = d[order], t[order], l[order].astype(np.int64)
        same = _classes(d, t)
        same[1:] &= l[1:] - l[:-1] <= 1
        same &= np.arange(len(l)) % 60_000 != 0  # widths fit 16 bits
        begin = np.flatnonzero(~same)
        end = np.append(begin[1:], len(l)) - 1
        return _blocks(GONE, _part(d[begin], self.parts), d=d[begin], t=t[begin], l=l[begin], w=l[end] - l[begin]) if len(l) else []


def _verify(body: np.ndarray, at: np.ndarray, same: np.ndarray) -> None:
    """Compare neighbours of a class byte by byte; a false meeting of hashes would end the job rather than cost text."""
    k = np.flatnonzero(same)
    for i in range(0, len(k), 100_000):
        x, y = at[k[i : i + 100_000]], at[k[i : i + 100_000] - 1]
        for step in range(LENGTH):
            if (body[x + step] != body[y + step]).any():
                raise RuntimeError("two different strings share a class")


class _Cut:
    def __call__(self, texts: pa.Table, marks: pa.Table) -> pa.Table:
        m = _read(marks, GONE)
        by = _by_row(m)
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
        for d, t, body in _documents(texts):
            n = spans_ = 0
            kept = body
            if (d, t) in by:
                k = by[d, t]
                edge = np.zeros(len(body) + 1, np.int64)
                np.add.at(edge, m["l"][k].astype(np.int64), 1)
                np.add.at(edge, m["l"][k].astype(np.int64) + m["w"][k] + LENGTH, -1)
                cut = np.cumsum(edge[:-1]) > 0
                n, spans_ = int(cut.sum()), int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                kept = np.frombuffer(body, np.uint8)[~cut].tobytes()
            for name, v in (("doc_id", None if d == _NONE else d), ("n_bytes", len(body)), ("n_removed", n), ("n_spans", spans_), ("kept", kept), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                out[name].append(v)
        kinds = {"kept": pa.binary(), "kept_sha256": pa.string()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})


class _Grams:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            for i, j in chunks(off, CHUNK):
                text, _, _, h, _ = spans(data[off[i] : off[j]], off[i : j + 1] - off[i])
                pair = np.unique(np.stack((text.astype(np.uint64), h)), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64))], names=["h"])


def remove_repeats(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256.

    A byte goes if a string of LENGTH bytes that covers it starts earlier too: in a row of smaller doc_id, or earlier in
    the same row. Strings are judged on the input; none crosses rows.

    A suffix array of every position would not fit an exchange, so suffixes are sampled by content: each string belongs
    to the anchor where its least q-gram hash lies, and the first buckets are the anchors' q-grams. A batch drops runs it
    holds twice but for the earliest, so copies reach an exchange once a batch. A bucket is refined by the content of
    whole runs; buckets of one content are settled. Of the others the bytes are fetched, and refine() doubles bucket
    pointers from STEP to LENGTH bytes on later offsets; classes are compared byte by byte. Buckets that a sample shows
    in over HOT_SHARE of documents are split by content and then by string (64 bits of hash beside 48 of the q-gram), so
    none gathers in one task. Texts travel compressed, in blocks by document.

    Null text: empty. Null doc_id: before all others. Rows that share a doc_id aren't earlier than one another, only than
    larger doc_ids. Texts of under LENGTH bytes keep everything. Empty table: no rows. Other columns are ignored.
    """
    bound_batches(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NONE)).alias("d"), body.alias("text"))
    n, alone, size = rows.agg(F.count("*"), F.countDistinct("d"), F.sum(F.octet_length("text"))).first()
    rows = rows.select("d", (F.lit(0).cast("long") if n == alone else F.xxhash64("text")).alias("t"), "text")
    parts = 64
    while parts * part_bytes < (size or 0):
        parts *= 2
    seen = min(n, SAMPLE)
    sample = rows.select("text").sample(min(1.0, SAMPLE / max(1, n)), 7).mapInArrow(_Grams(), "h long")
    hot = sample.groupBy("h").count().where(F.col("count") > max(50, HOT_SHARE * seen)).orderBy(F.desc("count"), "h").limit(MOST_HOT).collect()
    hot = np.sort(np.array([r.h for r in hot], np.int64).view(np.uint64))
    refine_, contents, settle, cut = _Refine(parts, hot), _Contents(parts), _Settle(parts), _Cut()
    first = rows.mapInArrow(_Anchors(parts, hot), BLOCK).groupBy("part").applyInArrow(lambda table: refine_(table), BLOCK)
    first = materialize(spark, first, "first")
    blocks = rows.mapInArrow(_Texts(parts), BLOCK)
    open_ = first.where(F.col("kind").isin(OPEN, OPEN_HOT))
    fetched = blocks.groupBy("part").cogroup(open_.groupBy("part")).applyInArrow(lambda a, b: contents(a, b), BLOCK)
    second = materialize(spark, fetched.groupBy("part").applyInArrow(lambda table: settle(table), BLOCK), "second")
    marks = first.where(F.col("kind") == GONE).union(second)
    return blocks.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(lambda a, b: cut(a, b), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
