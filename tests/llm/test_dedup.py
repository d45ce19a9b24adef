"""Exact, near and substring duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from cases import ROWS, by_row, docs, none
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import common, exact_dedup, similar, simhash, suffix


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def exact_brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact(spark):
    out = exact_dedup.exact_duplicates(spark, docs(spark), digest=True)
    assert by_row(out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == exact_brute(ROWS)
    assert exact_dedup.exact_duplicates(spark, none(spark)).count() == 0


def test_exact_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_LIMIT", 0)
    out = exact_dedup.exact_duplicates(spark, docs(spark), digest=True)
    assert by_row(out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == exact_brute(ROWS)


def slow_fingerprint(t):
    w = t.encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB cdé\n\t", max_size=60))
def test_fingerprint(t):
    assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


def components(values, linked):
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a in range(len(values)):
            for b in range(len(values)):
                if linked(values[a], values[b]) and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_near_edge_cases(spark):
    out = simhash.near_duplicates(spark, docs(spark)).collect()
    fps = [slow_fingerprint(t or "") for _, t, *_ in ROWS]
    root = components(fps, lambda x, y: bin(x ^ y).count("1") <= 3)
    want = []
    for k, (i, *_) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if root[j] == root[k] and ROWS[j][0] is not None]
        want.append((i, fps[k], min(ids, default=None)))
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(spark, none(spark)).count() == 0


@pytest.mark.parametrize("group", [0.05, 2, 512])
def test_links_find_every_pair(spark, group, monkeypatch):
    """Clusters around a few centres, in which chains of links matter; group=2 makes hot prefixes, 0.05 splits them often."""
    r = random.Random(3)
    values = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(40):
            values.add(x)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
    values = sorted(values)
    monkeypatch.setattr(simhash, "AT_ONCE", 5000)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    found = common.connected_components(spark, simhash.links(spark, fps, group)).collect()
    got = {r.node % (1 << 64): r.root for r in found}
    root = components(values, lambda x, y: bin(x ^ y).count("1") <= 3)
    sets = {}
    for v, k in zip(values, root, strict=True):
        sets.setdefault(k, set()).add(v)
    mine = {}
    for v in values:
        mine.setdefault(got.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, mine.values()))


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(0, k) for k in range(300, 400)] + [(k, k + 1) for k in range(500, 560)]
    got = {x.node: x.root for x in common.connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = root[min(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def cut_brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = {}, []
    for k in order:
        i, b = rows[k][0], (rows[k][1] or "").encode()
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            seen[w] = min(seen.get(w, (2, 0)), (0 if i is None else 1, i or 0))
    for k in order:
        i, b = rows[k][0], (rows[k][1] or "").encode()
        cut, own = [False] * len(b), set()
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if seen[w] < (0 if i is None else 1, i or 0) or w in own:
                cut[s : s + 100] = [True] * 100
            own.add(w)
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        spans = sum(c and not (s and cut[s - 1]) for s, c in enumerate(cut))
        out.append((i, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def cut(spark, rows, **kw):
    out = suffix.remove_repeats(spark, docs(spark, rows), **kw)
    return by_row(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def repeats(seed, n):
    r = random.Random(seed)
    text = lambda k: "".join(r.choice("abcdé ") for _ in range(k))
    shared = [text(r.choice((60, 99, 100, 101, 250, 900))) for _ in range(6)]
    return [(k, "".join(r.choice((text(r.randint(0, 150)), r.choice(shared))) for _ in range(r.randint(0, 6))), "en", "a") for k in range(n)]


def test_substrings(spark):
    rows = [x for x in ROWS if len(x[1] or "") < 10_000] + [(20, ROWS[6][1][:9000], "en", "a"), (21, "zz" + ROWS[6][1][100:9000], "en", "a")]
    assert cut(spark, rows) == cut_brute(rows)
    assert cut(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_at_random(spark, seed, monkeypatch):
    rows = repeats(seed, 80)
    assert cut(spark, rows) == cut_brute(rows)
    monkeypatch.setattr(suffix, "HOT_SHARE", 0.0)  # every bucket of over 2 documents is hot
    monkeypatch.setattr(suffix, "CHUNK", 2000)
    monkeypatch.setattr(suffix, "BATCH", 5000)
    assert cut(spark, rows, part_bytes=500) == cut_brute(rows)


def test_long_text_in_parts():
    data = np.frombuffer(random.Random(2).randbytes(3000), np.uint8)
    whole = suffix.spans(data, np.array([0, len(data)]))
    starts = [s for i, j in zip(whole[1], whole[2], strict=True) for s in range(i, j + 1)]
    assert starts == list(range(len(data) - 99))


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_similar_groups(spark, monkeypatch):
    r = random.Random(9)
    words = [f"w{k}" for k in range(300)]
    rows, k = [], 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(40, 120))]
        for _ in range(r.randint(1, 12)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(k, ""), (k + 1, "one"), (k + 2, "ONE"), (k + 3, None)]
    texts = [t or "" for _, t in rows]
    root = components(list(range(len(texts))), lambda a, b: a != b and jaccard(texts[a], texts[b]) >= 0.8)
    want = {i: root[i] for i in range(len(texts)) if root.count(root[i]) > 1}
    df = spark.createDataFrame(rows, "node long, text string")
    assert {x.node: x.root for x in similar.similar_groups(spark, df).collect()} == want
    monkeypatch.setattr(similar, "SMALL", 2)  # larger meetings as crowds: the same groups
    assert {x.node: x.root for x in similar.similar_groups(spark, df).collect()} == want
    assert similar.similar_groups(spark, spark.createDataFrame([], "node long, text string")).count() == 0


@pytest.mark.parametrize("block", [1 << 19, 1 << 13])
def test_similar_crowds(spark, monkeypatch, block):
    """A template that hundreds share below the threshold, with chains of edited copies in it, whose links lie just above it.
    SMALL=2 has the meetings of a crowd many times larger; block=1<<13 makes many blocks."""
    monkeypatch.setattr(similar, "SMALL", 2)
    monkeypatch.setattr(similar, "BLOCK", block)
    r = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    head, texts = [r.choice(words) for _ in range(140)], []
    for _ in range(120):
        text = head + [r.choice(words) for _ in range(r.randint(24, 30))]
        for _ in range(r.choice((1, 2, 3))):
            texts.append(" ".join(text))
            text = list(text)
            for k in r.sample(range(8, len(text) - 8, 8), 3):  # 17 of some 163 shingles
                text[k] = r.choice(words)
            text[k + 2] = r.choice(words)
    r.shuffle(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    links = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = components(list(range(len(texts))), lambda a, b: (a, b) in links)
    want = {k: root[k] for k in range(len(texts)) if root.count(root[k]) > 1}
    assert len(set(want.values())) > 10 and max(root.count(x) for x in root) < len(texts) / 2
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    assert {x.node: x.root for x in similar.similar_groups(spark, df).collect()} == want


def test_links_are_counted_out(spark):
    """Estimates that are far off: equal minima of texts at 0.5, and minima of which 0.67 are equal of equal texts."""
    same = " ".join(f"w{k}" for k in range(60))
    rows = spark.createDataFrame([(1, same), (2, " ".join(f"w{k}" for k in range(20, 80))), (3, same)], "node long, text string")
    sig = np.arange(similar.BANDS * similar.ROWS, dtype=np.uint32)
    far = np.where(sig % 3 == 0, sig + 1000, sig).astype(np.uint32)
    sketch = spark.createDataFrame([(1, bytearray(sig.tobytes())), (2, bytearray(sig.tobytes())), (3, bytearray(far.tobytes()))], "node long, sig binary")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {(x.a, x.b): x.alike for x in similar._check(spark, rows, sketch, edges, 5, 0.8).collect()} == {(1, 2): False, (1, 3): True}
