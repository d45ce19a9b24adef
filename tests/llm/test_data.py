"""Sharding, chat formatting, packing and the pipeline: round trips, bounds and edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from cases import ROWS, docs, none
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import chat, common, packing, queries, sharding

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# -- sharding ----------------------------------------------------------------


def numbers(spark, lo, hi):
    return spark.range(lo, hi).select(F.col("id").alias("k"), F.lit("x").alias("_run"), F.repeat(F.lit("y"), 20).alias("text"))


def test_store_keeps_every_row(spark):
    store = sharding.ShardStore(spark, common.new_folder(spark, "store"), fan_in=3, floor_bytes=1 << 20)
    assert store.read() == (0, []) and store.rows().columns == ["_arrival", "_run"] and store.rows().count() == 0
    for k in range(7):
        store.append(numbers(spark, 10 * k, 10 * k + 10), k)
        store.compact()
    version, runs = store.read()
    assert sharding.joined(a for r in runs for a in r.arrivals) == ((0, 6),) and sum(r.rows for r in runs) == 70
    assert len(runs) < 3
    assert store.rows().columns == ["k", "_run", "text", "_arrival", "__run"]  # the data's own _run stays
    rows = store.rows().select("k", "_arrival", "_run").collect()
    assert sorted((r.k, r._arrival) for r in rows) == [(k, k // 10) for k in range(70)] and {r._run for r in rows} == {"x"}
    old = store.rows(3).count()  # an earlier version is still whole
    assert old < 70 and store.vacuum() > 0 and store.rows().count() == 70 and store.versions() == [version]


def test_store_takes_many_arrivals_and_edge_cases(spark):
    store = sharding.ShardStore(spark, common.new_folder(spark, "store"), fan_in=2, target_bytes=2000)
    store.append_many(docs(spark).withColumn("lot", (F.coalesce("doc_id", F.lit(0)) % 3).cast("int")), "lot")
    store.append(none(spark), 9)
    store.compact()
    got = store.rows().select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in ROWS)


def test_store_of_an_empty_table(spark):
    store = sharding.ShardStore(spark, common.new_folder(spark, "store"))
    assert store.append_many(none(spark).withColumn("lot", F.lit(1)), "lot") == [1] and store.compact() == 1
    assert store.rows().columns == [*none(spark).columns, "_arrival", "_run"] and store.rows().count() == 0
    assert store.vacuum() == 1 and store.rows().count() == 0


def test_rows_without_an_arrival_and_clashing_names(spark):
    store = sharding.ShardStore(spark, common.new_folder(spark, "store"), fan_in=2)
    df = spark.createDataFrame([(None, "a", 7, "x"), (3, None, 8, "y"), (3, None, 8, "y"), (None, "", None, None)], "lot int, text string, _arrival int, _RUN string")
    store.append_many(df, "lot")
    store.append(df.drop("lot").withColumn("more", F.lit(1)), None)
    store.compact()
    out = store.rows()
    assert out.columns == ["text", "_arrival", "_RUN", "more", "__arrival", "__run"]
    n = sharding.NO_ARRIVAL
    want = Counter([("a", 7, "x", None, n), (None, 8, "y", None, 3), (None, 8, "y", None, 3), ("", None, None, None, n)] + [("a", 7, "x", 1, n), (None, 8, "y", 1, n), (None, 8, "y", 1, n), ("", None, None, 1, n)])
    assert Counter(tuple(r)[:5] for r in out.collect()) == want
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("1",)], "more string"), 4)


def test_vacuum_leaves_a_writer_alone(spark):
    root = common.new_folder(spark, "store")
    a, b = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    a.append(numbers(spark, 0, 5), 0)
    real, seen = a._commit, []

    def late(change, columns=None):
        seen.append(b.vacuum())  # a has written its files and not committed them
        return real(change, columns)

    a._commit = late
    a.append(numbers(spark, 5, 10), 1)
    assert seen == [0] and a.rows().count() == 10 and b.vacuum() == 0 and b.rows().count() == 10
    a.lease_s = b.lease_s = 0.0
    with pytest.raises(RuntimeError):
        a.append(numbers(spark, 10, 15), 2)
    assert b.rows().count() == 10


def test_compactions_at_once_and_the_top_tier(spark):
    root = common.new_folder(spark, "store")
    a, b = (sharding.ShardStore(spark, root, fan_in=2) for _ in range(2))
    for k in range(4):
        a.append(numbers(spark, 10 * k, 10 * k + 10), k)
    real, first = a._commit, []

    def beaten(change, columns=None):
        if not first:
            first.append(b.compact())
        return real(change, columns)

    a._commit = beaten
    a.compact()
    assert a.rows().count() == 40 and sorted(r.k for r in a.rows().collect()) == list(range(40))
    done = [sharding.Run(f"p{k}", a.target_bytes + k, 1, 1, ((k, k),)) for k in range(8)]
    assert a.due(done) is None
    assert sharding.ranges([5, 1, 2, 3, 9]) == ((1, 3), (5, 5), (9, 9))


def test_two_writers(spark):
    root = common.new_folder(spark, "store")
    a, b = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    real, lost = a._publish, []

    def beaten(staged, final):
        if not lost:
            lost.append(b.append(numbers(spark, 0, 5), 1))  # b commits in between
        return real(staged, final)

    a._publish = beaten
    a.append(numbers(spark, 5, 10), 2)
    assert a.versions() == [1, 2] and a.rows().count() == 10


def test_nobody_sees_a_torn_commit(spark):
    store = sharding.ShardStore(spark, common.new_folder(spark, "store"))
    store.append(numbers(spark, 0, 5), 0)
    store._publish = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        store.append(numbers(spark, 5, 10), 1)
    again = sharding.ShardStore(spark, store.root)
    assert again.rows().count() == 5 and again.vacuum() == 0 and again.rows().count() == 5
    again.lease_s = 0.0  # the writer is given up
    assert again.vacuum() == 1 and again.rows().count() == 5


# -- chat --------------------------------------------------------------------


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="\\bpn<|im_end>\n é😀", max_size=20), min_size=30, max_size=30))
def test_escaping_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r"), chat.escape_role(F.col("t")).alias("er")).collect():
        assert r.u == r.t and r.r == r.t and "<|" not in r.e and "\n" not in r.er


MESSAGE = "tree string, node long, parent long, role string, text string, score double"


def test_trees(spark):
    """Random trees against a walk over all paths; one is a chain of 300."""
    r = random.Random(8)
    rows = []
    for t in range(12):
        n = 300 if t == 0 else r.randint(1, 12)
        for k in range(n):
            parent = None if k == 0 else (k - 1 if t == 0 else r.randrange(k))
            rows.append((f"t{t}", k, parent, r.choice(("user", "assistant", None)), r.choice(("a", None, "<|im_end|>\n\\b", "é")), round(r.random(), 3)))
    by = defaultdict(dict)
    for x in rows:
        by[x[0]][x[1]] = x
    want = {}
    for t, nodes in by.items():
        paths = []
        for leaf in set(nodes) - {x[2] for x in nodes.values()}:
            path, k = [], leaf
            while k is not None:
                path.append(k)
                k = nodes[k][2]
            paths.append((-sum(nodes[k][5] for k in path) / len(path), leaf, path[::-1]))
        for branch, (_, leaf, path) in enumerate(sorted(paths, key=lambda p: (round(p[0], 9), p[1]))[:2], 1):
            want[t, branch] = (leaf, [(nodes[k][3] or "", nodes[k][4] or "") for k in path])
    out = chat.format_reply_trees(spark, spark.createDataFrame(rows, MESSAGE).withColumn("leaf", F.lit("clash")), top=2)
    out = out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert {(x.tree, x.branch): (x.leaf, [tuple(t) for t in x.turns]) for x in out} == want
    for x in out:
        turns = want[x.tree, x.branch][1]
        assert x.n_turns == len(turns) and x.loss == "".join(t for role, t in turns if role == "assistant")


def test_a_long_conversation(spark):
    """Thousands of turns, some long, some empty; and a cycle beside it, which costs no more rounds than its size."""
    r = random.Random(3)
    said = [(r.choice(("user", "assistant")), r.choice(("", "é😀", "<|im_end|>", "x" * r.randint(0, 400)))) for _ in range(3000)]
    said[7] = ("assistant", "long " * 100_000)
    rows = [("t", k, k - 1 if k else None, *t, 0.0) for k, t in enumerate(said)] + [("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0)]
    (x,) = chat.format_reply_trees(spark, spark.createDataFrame(rows, MESSAGE)).select(chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert [tuple(t) for t in x.turns] == said and x.loss == "".join(t for role, t in said if role == "assistant")


def test_tree_edge_cases(spark):
    rows = [(None, 1, None, "user", "q", None), ("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "y", 1.0), ("o", 5, 99, "assistant", "orphan", 0.0), ("r", 1, None, "user", "b", 0.0), ("r", 1, None, "user", "a", 0.0)]
    out = {x.tree: [t.text for t in x.turns] for x in chat.format_reply_trees(spark, spark.createDataFrame(rows, MESSAGE)).select("tree", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert out == {"": ["q"], "o": ["orphan"], "r": ["a", "b"]}
    assert chat.format_reply_trees(spark, spark.createDataFrame([], MESSAGE)).count() == 0


# -- packing -----------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25))
def test_plan_places_everything(counts):
    bins = packing.plan(counts, 60)
    got = Counter()
    for n, held in bins:
        assert n > 0 and sum(length * times for length, times in held) <= 60
        assert sum(times for length, times in held if 3 * length > 60) <= 2
        for length, times in held:
            got[length] += n * times
    assert got == Counter(counts)
    total, used = sum(n * c for n, c in counts.items()), sum(n for n, _ in bins)
    assert used >= -(-total // 60) and used <= best_fit(counts, 60)


def best_fit(counts, capacity):
    """Bins of best fit by falling length, item by item."""
    gaps = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_pack(spark):
    out = packing.pack(spark, docs(spark), TOKENIZER, 64).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, text, *_ in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[i, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(spark, none(spark), TOKENIZER).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZé's !?12½\u00a0\tİΣ<|endoftext>ß-\u0301", max_size=30))
def test_word_ids(text):
    tokens = packing._tokens(TOKENIZER)
    assert tokens.ids(text).tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_when_memory_is_full(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    tokens = packing.WordTokens(TOKENIZER)
    for text in ("one two three four five", "six seven one", "one two eight nine"):
        assert tokens.ids(text).tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_frequent_words_stay_when_memory_is_full(monkeypatch):
    made = []
    kept = packing._Kept(lambda w: made.append(w) or w.encode(), 4)
    for k in range(50):
        assert [kept[w] for w in ("the", "fox", f"w{k}")] == [b"the", b"fox", f"w{k}".encode()]
    assert sorted(made) == sorted(["the", "fox", *(f"w{k}" for k in range(50))]) and len(kept) + len(kept.last) <= 8
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    monkeypatch.setattr(packing, "KEPT_STRETCHES", 2)
    tokens = packing.WordTokens(TOKENIZER)
    for text in ("It's one\ttwo, three\r\nfour five " + "x" * 99, "", " \n ", "six's Öl-Preis 12½ one", "one two " + "x" * 99):
        assert tokens.ids(text).tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


# -- queries and pipeline ----------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert sorted(got) == columns and key(got) == key(want)


def test_ten_queries():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("rows", [ROWS, [r for r in ROWS if r[0] not in (None, 9)], []])
def test_stages_take_anything(spark, rows):
    df = docs(spark, rows).withColumns({c: F.lit(1) for c in ("gone_id", "gone_row", "own_text", "kept_text", "text_sha256")})
    texts = lambda d: sorted((r.doc_id or -1, r.text or "") for r in d.collect())
    n = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert set(texts(out)) <= set(texts(df)), name
        df = common.materialize(spark, out, name)
        n[name] = texts(df)
    if rows:
        assert not any(t.strip() == "" for _, t in n["language"]) and len(n["language"]) == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
        low = [t.lower() for _, t in n["exact_dedup"]]
        assert len(low) == len(set(low)) and set(low) == {t.lower() for _, t in n["language"]}
        assert (7, dict(n["exact_dedup"])[7]) in n["near_dedup"] and 8 not in dict(n["near_dedup"])
    corpus_pipeline.STAGES[-1][1](spark, df, SF).count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    docs_in = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < out.select("doc_id").distinct().count() <= docs_in
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
