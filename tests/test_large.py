"""What larger tables have that the smallest don't: prices of 0, many copies, many rows at one time."""

import datetime
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewire import storage
from tidewire.functions import squawk
from tidewire.operators import dedup, moves, score
from tidewire.plans import oracle, queries
from tidewire.storage import shared_folder


def rows(pdf, columns):
    return sorted(map(tuple, pdf[columns].astype(str).values.tolist()))


def equals_sql(spark, folder, name, table):
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = queries.queries()[name](spark, str(folder)).toPandas(), con.sql(oracle.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    assert rows(got, sorted(got)) == rows(want, sorted(want))
    return got


@pytest.mark.parametrize("name", ["ewma_baseline", "quick_moves", "live_moves", "move_news_correlation", "news_move_correlation"])
def test_a_price_of_0_is_measured_as_in_the_sql(spark, tmp_path, name):
    at = datetime.datetime(2024, 1, 1)
    made = [(k, at + datetime.timedelta(minutes=31 * k, seconds=k % 7), k % 9, "click", 0.0 if k in (90, 131) else 20.0 + k % 5 * 7, f'{{"k": {k % 50}}}') for k in range(200)]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"copy (select * from '{tmp_path}/events.parquet/*.parquet') to '{tmp_path}/e.parquet' (format parquet)")
    folder = tmp_path / "d"
    folder.mkdir()
    (tmp_path / "e.parquet").rename(folder / "events.parquet")
    got = equals_sql(spark, folder, name, "events")
    if name == "quick_moves":
        assert (got.price_to == 0).any() or (got.price_from == 0).any()


def bytes_under(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_pairs_write_less_than_the_texts(spark):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=1)[0] + str(rng.randrange(5000)) for _ in range(400)) for _ in range(200)]
    items = spark.createDataFrame([(k, k * 60.0, t if k % 10 else texts[max(0, k - 3)]) for k, t in enumerate(texts)], "seq long, ts double, headline string")
    was = bytes_under(folder)
    got = dedup.deduplicate(spark, items).where("duplicate_of is not null").collect()
    assert {(x.seq, x.duplicate_of) for x in got} == {(k, k - 3) for k in range(10, 200, 10)}
    assert bytes_under(folder) - was < sum(map(len, texts)) / 20


def test_crowded_times_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(9)]
    made = [(k, float(rng.choice((k * 40, 3000, 90_000))), " ".join(rng.choices(words, k=rng.randrange(6)))) for k in range(300)]
    items = spark.createDataFrame(made, "seq long, ts double, headline string")
    want = sorted(map(tuple, dedup.similar_pairs(items).collect()))
    for most in (0, 40):
        monkeypatch.setattr(dedup, "BUCKET_ITEMS", most)
        assert sorted(map(tuple, dedup.similar_pairs(items).collect())) == want
    assert want


def test_texts_that_repeat_are_read_once(spark, monkeypatch):
    """What texts alone say is made of the distinct ones: the costly step sees 40 rows, not 4000; without repeats every row is read."""
    df = spark.range(4000).select(F.col("id").alias("seq"), F.when(F.col("id") % 40 != 7, F.concat(F.lit("Fed raises rates by 2 bps "), F.col("id") % 40)).alias("headline"), F.lit("ecb").alias("source"), F.col("id").cast("double").alias("ts"))
    seen = []
    read = score._read
    monkeypatch.setattr(score, "_read", lambda x, c: seen.append(x.count()) or read(x, c))
    few = sorted(map(str, score.score_news(df).drop("all_symbols").collect()))
    monkeypatch.setattr(storage, "FEW_BYTES", 64)
    assert sorted(map(str, score.score_news(df).drop("all_symbols").collect())) == few
    assert seen == [40, 4000] and len(few) == 4000


@pytest.mark.parametrize("limit", [storage.FEW_BYTES, 64])
def test_tape_lines_of_repeated_headlines(spark, monkeypatch, limit):
    monkeypatch.setattr(storage, "FEW_BYTES", limit)
    rows = [(k, h, s, y, "old") for k, (h, s, y) in enumerate([("ECB's Lagarde: we are not done yet", "x", []), ("Acme up 2 percent", "ecb", ["ACME"]), ("Acme up 2 percent", "ecb", []), (None, "ecb", [])] * 3)]
    got = squawk.with_tape_line(spark.createDataFrame(rows, "seq long, headline string, source string, symbols array<string>, body string"), F.lit("ZZ")).orderBy("seq").collect()
    want = [("ECB'S LAGARDE: WE ARE NOT DONE YET", "EU"), ("ACME UP 2%", "EU"), ("ACME UP 2%", "EU"), (None, "EU")] * 3
    assert [(x.body, x.region) for x in got] == want


@pytest.mark.parametrize("most", [90, 10**6])
def test_anchors_by_stretches_with_ties(spark, monkeypatch, most):
    """Ticks of one time count in each other's volume; a symbol is cut into stretches without a change."""
    monkeypatch.setattr(moves, "ANCHOR_ROWS", most, raising=False)
    rng = random.Random(4)
    ticks = [("ab"[k % 2], k, float(rng.randrange(400)), float(k + 1), float(rng.randrange(9))) for k in range(300)]
    got = moves.anchors(spark.createDataFrame(ticks, "symbol string, seq long, ts double, price double, volume double"), (20.0, 50.0), 70.0).collect()
    assert len(got) == len(ticks)
    for r in got:
        for w in (20, 50):
            seen = [(t, k, p) for s, k, t, p, _ in ticks if s == r.symbol and r.ts - 70 <= t <= r.ts - w]
            assert r[f"anchor_{w}"] == (max(seen)[2] if seen else None)
            assert r[f"volume_{w}"] == sum(v for s, _, t, _, v in ticks if s == r.symbol and r.ts - w < t <= r.ts)


def test_copies_at_one_time_are_never_paired(spark, monkeypatch):
    """3,000 items of 42 texts within ttl_s of each other: pairs are made of texts only, and what goes is as read one by one."""
    rng = random.Random(12)
    words = ["fed", "rates", "oil", "ecb", "cut", "rise", "bank"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(2, 7))) for _ in range(40)] + ["", None]
    times = [float(rng.choice((rng.randrange(9000), 500, 3200))) for _ in range(3000)]
    times[7], times[8], times[9] = float("nan"), float("inf"), None
    made = [(rng.randrange(10**6) * 3000 + k, t, rng.choice(texts)) for k, t in enumerate(times)]
    items = spark.createDataFrame(made, "seq long, ts double, headline string")
    seen = []
    pairs = dedup.similar_pairs
    monkeypatch.setattr(dedup, "similar_pairs", lambda x, c=None: seen.append(x.count()) or pairs(x, c))
    got = {r.seq: r.duplicate_of for r in dedup.deduplicate(spark, items).collect()}
    assert max(seen) <= 42
    kept, want = [], {}
    shingled = lambda t: (w := (t or "").split()) and (set(zip(w, w[1:])) or set(w))
    alike = lambda a, b: bool(a and b) and (len(a & b) / len(a | b) >= 0.62 or len(a & b) / min(len(a), len(b)) >= 0.8)
    timed = sorted((t, s, shingled(x)) for s, t, x in made if t is not None and abs(t) < float("inf"))
    for t, s, x in timed:
        want[s] = next((k for u, k, y in kept if t - u <= 2700 and alike(x, y)), None)
        if want[s] is None:
            kept.append((t, s, x))
    assert got == {s: want.get(s) for s, _, _ in made}
    assert sum(v is not None for v in want.values()) > 2000
    for limit, least in (("TEXTS", 5), ("LINKS", 3)):  # more than these, and pairs of items settle it
        monkeypatch.setattr(dedup, limit, least)
        assert {r.seq: r.duplicate_of for r in dedup.deduplicate(spark, items).collect()} == got


def test_no_two_busy_symbols_share_a_task(spark):
    names = [f"S{k}" for k in range(4)]
    ticks = spark.createDataFrame([(names[k % 4] if k % 50 else None, k, float(k), 1.0, 1.0) for k in range(400)], "symbol string, seq long, ts double, price double, volume double")
    dealt = moves.in_order(ticks).withColumn("task", F.spark_partition_id())
    assert dealt.groupBy("symbol").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0
    assert dealt.where("symbol is not null").select("task").distinct().count() == 4
    assert dealt.count() == 400
