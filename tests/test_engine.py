"""Moves, deduplication, correlation, sources and streams."""

import json
import random
import re
import threading
import time
import urllib.error
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.operators import correlate, dedup, follow, moves, score
from tidewire.sources import feeds, http, prices, registry
from tidewire.streaming import live, sinks

TICK = "symbol string, seq long, ts double, price double, volume double"


def found(spark, rows, **cfg):
    return moves.quick_moves(spark.createDataFrame(rows, TICK), rules.MoveConfig(**cfg)).collect()


def then(rows, *more):
    rows = list(rows)
    for dt, factor, volume in more:
        s, k, ts, p, _ = rows[-1]
        rows.append((s, k + 1, ts + dt, p * factor, volume))
    return rows


CALM = prices.walk(200, seed=3)


def test_calm_is_silent_and_a_shock_fires_once(spark):
    assert found(spark, CALM) == []
    (m,) = found(spark, then(CALM, (5, 0.97, 20000.0)))
    assert m.ret < -0.02 and not m.reversal


def test_warmup_cooldown_volume_reversal(spark):
    assert found(spark, then(prices.walk(10), (5, 0.9, 20000.0)), warmup=100) == []
    assert len(found(spark, then(CALM, *[(5, 0.97, 20000.0)] * 4), cooldown_s=600.0)) == 1
    assert found(spark, then(CALM, (5, 0.985, 1.0)), hard_ret=0.1, min_volume_ratio=3.0) == []
    last = found(spark, then(CALM, (5, 0.96, 20000.0), (400, 1.02, 20000.0)), cooldown_s=1.0)[-1]
    assert last.reversal


def test_prices_of_nothing_are_never_measured(spark):
    assert found(spark, then(CALM, (5, 0.0, 10.0))) == []


def test_frames_equal_the_fold(spark):
    out = moves.anchors(spark.createDataFrame(CALM, TICK), (60.0, 300.0), 3600.0).orderBy("seq").collect()
    for k, r in enumerate(out):
        seen = CALM[: k + 1]
        want = [p for _, _, t, p, _ in seen if t <= r.ts - 60 and t >= r.ts - 3600]
        assert r.anchor_60 == (want[-1] if want else None)
        assert r.volume_60 == pytest.approx(sum(v for _, _, t, _, v in seen if t > r.ts - 60))


def test_look_back_in_any_order():
    r = random.Random(2)
    cfg = rules.MoveConfig(windows_s=(10.0, 40.0), history_s=100.0)
    st, ts = moves.SymbolState(), 0.0
    for k in range(600):
        ts += r.choice((0.0, 1.0, 5.0, 30.0, 200.0 if r.random() < 0.02 else 1.0)) if r.random() > 0.03 else -7.0
        st.ticks.append((ts, float(k), float(r.randint(0, 9))))
        while st.ticks[0][0] < ts - cfg.history_s:
            st.ticks.popleft()
        anchors, volumes = moves.look_back(st, ts, cfg)
        for w, a, v in zip(cfg.windows_s, anchors, volumes, strict=True):
            before = [p for t, p, _ in st.ticks if t <= ts - w]
            assert a == (before[-1] if before else None) and v == sum(x for t, _, x in st.ticks if t > ts - w)


def test_correlation_both_ways(spark):
    news = [(1, "n1", "OPEC announces surprise output cut", "reuters", 0.0, "", ["TSN"], "")]
    schema = "seq long, id string, headline string, source string, ts double, body string, symbols array<string>, url string"
    ticks = then([(("TSN"), k, t, p, v) for _, k, t, p, v in CALM], (5, 0.97, 20000.0))
    at = ticks[-1][2]
    for offset, kinds in ((-30.0, ["confirmed", "news_critical"]), (30.0, ["confirmed", "unexplained_move"])):
        items = spark.createDataFrame([(*n[:4], at + offset, *n[5:]) for n in news], schema)
        alerts, _ = follow.follow(spark, items, spark.createDataFrame(ticks, TICK), rules.FollowConfig(correlate_s=600.0))
        assert sorted(r.kind for r in alerts.collect()) == kinds
        assert follow.tape(alerts, registry.sources(spark)).count() == 2


def test_first_fit_is_sequential(spark):
    r = random.Random(1)
    for _ in range(6):
        n = 30
        edges = {(b, a) for a in range(n) for b in range(a + 1, n) if r.random() < 0.08}
        kept, gone = [], {}
        for v in range(n):
            hit = next((k for k in kept if (v, k) in edges), None)
            if hit is None:
                kept.append(v)
            else:
                gone[v] = hit
        pairs = spark.createDataFrame(sorted(edges), "seq long, earlier long")
        assert {x.seq: x.duplicate_of for x in dedup.first_fit(spark, pairs).collect()} == gone


def test_a_long_chain_and_rounds(spark):
    """Each story matches only the one before; and random graphs by rounds and by the pass in order, in any numbering."""
    pairs = spark.createDataFrame([(k + 1, k) for k in range(2000)], "seq long, earlier long")
    want = {k: k - 1 for k in range(1, 2001, 2)}
    assert {x.seq: x.duplicate_of for x in dedup.first_fit(spark, pairs).collect()} == want
    assert {x.seq: x.duplicate_of for x in dedup.first_fit(spark, pairs.limit(300), at_once=250).collect()} == {k: v for k, v in want.items() if k <= 300}
    r = random.Random(8)
    order = list(range(60))  # numbers in order of time
    r.shuffle(order)
    edges = [(order[b], float(b), order[a], float(a)) for a in range(60) for b in range(a + 1, 60) if r.random() < 0.1]
    kept, gone = [], {}
    for k, v in enumerate(order):
        hit = next((a for a in kept if (v, float(k), order[a], float(a)) in edges), None)
        if hit is None:
            kept.append(k)
        else:
            gone[v] = order[hit]
    pairs = spark.createDataFrame(edges, "seq long, ts double, earlier long, earlier_ts double")
    for at_once in (0, 10**9):
        assert {x.seq: x.duplicate_of for x in dedup.first_fit(spark, pairs, at_once).collect()} == gone


def shingle_set(headline):
    w = [x for x in re.findall("[a-z0-9$%.]+", headline.lower()) if x not in rules.STOP_WORDS and len(x) > 1]
    return set(w) if len(w) < 2 else {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def alike(a, b, cfg):
    both = len(a & b)
    return both > 0 and (both / len(a | b) >= cfg.similarity or both / min(len(a), len(b)) >= cfg.containment)


def test_pairs_at_random(spark):
    r, words = random.Random(5), [f"w{k}" for k in range(9)]
    rows = [(k, r.uniform(0, 9000), " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for k in range(150)]
    cfg = rules.NewsConfig()
    by = sorted(rows, key=lambda x: (x[1], x[0]))
    want = {(b[0], a[0]) for i, a in enumerate(by) for b in by[i + 1 :] if b[1] - a[1] <= cfg.ttl_s and alike(shingle_set(a[2]), shingle_set(b[2]), cfg)}
    got = dedup.similar_pairs(spark.createDataFrame(rows, "seq long, ts double, headline string")).collect()
    assert {(x.seq, x.earlier) for x in got} == want and len(got) == len(want) > 40


def test_follower_is_sequential(spark):
    """Headlines and ticks numbered out of order, against one pass over them in order of time."""
    r, cfg = random.Random(9), rules.FollowConfig(news=rules.NewsConfig(ttl_s=400.0), correlate_s=60.0)
    told = ("OPEC announces surprise output cut", "OPEC announces surprise output cut of oil", "Fed raises rates by 50 basis points", "Fed raises interest rates by 50 bps today", "Quiet day", "Acme files for bankruptcy, credit default feared")
    numbers = r.sample(range(1000), 120)
    items = [(n, f"i{n}", r.choice(told), "reuters", r.uniform(0, 3000), "", r.sample(["SYN", "OTH", "X"], r.randint(0, 3)), "") for n in numbers]
    ticks = [*prices.walk(600, seed=3), *prices.walk(600, "OTH", seed=4)]
    ticks = [(s, k, t, p * (0.9 if k % 97 > 90 else 1), v * (15 if k % 97 in (91, 92) else 1)) for s, k, t, p, v in ticks]
    frame = spark.createDataFrame(items, "seq long, id string, headline string, source string, ts double, body string, symbols array<string>, url string")
    tick_frame = spark.createDataFrame(ticks, TICK)
    scored = {x.seq: x for x in score.score_news(frame, cfg.news).collect()}
    found = moves.quick_moves(tick_frame, cfg.move).collect()
    kept, news, moved, alerts, dropped = [], [], [], [], []
    events = [(i[4], 0, i[0], i) for i in items] + [(m.ts, 1, m.seq, m) for m in found]
    for ts, kind, seq, x in sorted(events, key=lambda e: e[:3]):
        if kind:
            moved.append(x)
            hit = next((n for n in reversed(news) if x.symbol in n[1] and ts - n[0] <= cfg.correlate_s), None)
            alerts.append(("confirmed" if hit else "unexplained_move", ts, x.symbol, hit and hit[2]))
            continue
        s = scored[seq]
        if s.priority < rules.NORMAL:
            dropped.append(seq)
            continue
        own = shingle_set(x[2])
        if any(ts - t <= cfg.news.ttl_s and alike(own, k, cfg.news) for t, k in kept):
            dropped.append(seq)
            continue
        kept.append((ts, own))
        news.append((ts, list(s.all_symbols), x[2]))
        hit = next((m for y in s.all_symbols for m in reversed(moved) if m.symbol == y and ts - m.ts <= cfg.correlate_s), None)
        if hit:
            alerts.append(("confirmed", ts, hit.symbol, x[2]))
        elif s.priority >= cfg.min_priority:
            alerts.append(("news_critical", ts, None, x[2]))
        else:
            dropped.append(seq)
    got, gone = follow.follow(spark, frame, tick_frame, cfg)
    assert sorted((a.kind, a.ts, a.move and a.move.symbol, a.item and a.item.headline) for a in got.collect()) == sorted(alerts, key=lambda a: a[:2])
    assert sorted(x.seq for x in gone.collect()) == sorted(dropped)
    assert {a[0] for a in alerts} == {"confirmed", "unexplained_move", "news_critical"} and len(dropped) > 20


def test_time_to_live(spark):
    df = spark.createDataFrame([(0, 0.0, "OPEC output cut shocks oil"), (1, 30.0, "OPEC output cut shocks oil"), (2, 500.0, "OPEC output cut shocks oil"), (3, 501.0, "")], "seq long, ts double, headline string")
    got = {r.seq: r.duplicate_of for r in dedup.deduplicate(spark, df, rules.NewsConfig(ttl_s=60.0)).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: None}


RSS = b"""<rss version="2.0"><channel><title>t</title>
<item><title>First &amp;amp; best</title><link>http://x/1</link><guid>g1</guid><description>&lt;b&gt;Hi&lt;/b&gt;</description><pubDate>Sat, 29 Aug 2026 10:30:00 GMT</pubDate></item>
<item><title>Second</title><pubDate>Sat, 29 Aug 2026 10:00:00 GMT</pubDate></item><item><title></title></item></channel></rss>"""


def test_feeds(spark):
    bodies = spark.createDataFrame([("a", bytearray(RSS)), ("b", bytearray(b"<rss><oops")), ("c", bytearray(b"")), ("d", None)], "source string, body binary")
    out = feeds.parse_feeds(bodies, F.lit(1234.0)).orderBy("ts").collect()
    assert [(r.headline, r.body) for r in out] == [("Second", ""), ("First & best", "Hi")]
    assert feeds.unseen(feeds.parse_feeds(bodies), spark.createDataFrame([("a", out[0].id)], "source string, id string")).count() == 1
    df = spark.createDataFrame([("1", "h", "s", -2, None)], "id string, headline string, source string, offset_min int, symbols array<string>")
    assert feeds.example_items(df, 1000.0).first().ts == 880.0


def test_registry(spark):
    assert [registry.sources(spark, *x).count() for x in ((), (True,), (True, True))] == [24, 22, 10]


class Wire:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, request, timeout):
        self.asked.append(dict(request.header_items()))
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


class Reply(SimpleNamespace):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        return self.body


def test_polling():
    gone = urllib.error.HTTPError("u", 304, "", {}, None)
    busy = urllib.error.HTTPError("u", 503, "", {"Retry-After": "soon"}, None)
    wire = Wire(Reply(status=200, body=b"x", headers={"ETag": "e"}), gone, busy, OSError("down"))
    p = http.Poller(open=wire)
    assert p.get("http://u", 0.0).ok and p.get("http://u", 1.0).not_modified
    assert wire.asked[1]["If-none-match"] == "e"
    assert p.get("http://u", 2.0).status == 503 and 50 <= p.of("http://u")["after"] - 2 <= 72
    assert p.get("http://u", 3.0).error == "backoff"
    assert "down" in p.get("http://u", 100.0).error and 48 <= p.of("http://u")["after"] - 100 <= 72


def test_streams(spark, tmp_path):
    live.configure(spark)
    ticks = spark.createDataFrame(then(CALM, (5, 0.97, 20000.0)), TICK)
    items = spark.createDataFrame([(1, "OPEC announces surprise output cut (SYN)", "reuters", CALM[-1][2]), (2, "OPEC announces surprise output cut", "cnbc", CALM[-1][2] + 1)], "seq long, headline string, source string, ts double")
    ticks.write.parquet(f"{tmp_path}/t")
    items.write.parquet(f"{tmp_path}/i")
    read = lambda n, df: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{n}")
    q = live.live_alerts(read("i", items), read("t", ticks)).writeStream.format("memory").queryName("alerts").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("alerts").collect()
    assert sorted(r.kind for r in got) == ["confirmed", "news_critical"]
    assert live.warm(ticks).first().n == 200


def test_backlog_warms_without_reporting(spark, tmp_path):
    live.configure(spark)
    backlog = spark.createDataFrame(then(CALM, (5, 0.97, 20000.0)), TICK)  # its own shock isn't reported, but starts a cooldown
    last = backlog.orderBy(F.desc("seq")).first()
    more = [("SYN", last.seq + 1, last.ts + 5, last.price * 0.97, 20000.0), ("SYN", last.seq + 2, last.ts + 10, last.price * 1.05, 90000.0), ("NEW", 1, 0.0, 1.0, 1.0)]
    ticks = spark.createDataFrame(more, TICK)
    ticks.write.parquet(f"{tmp_path}/t")
    q = live.live_moves(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/t"), backlog=backlog).writeStream.format("memory").queryName("warmed").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("warmed").collect()
    assert [(r.seq, r.ret > 0, r.reversal) for r in got] == [(last.seq + 2, True, True)]


def test_described(spark):
    news = [(1, "n1", "OPEC announces surprise output cut", "reuters", 0.0, "", [], "")]
    items = spark.createDataFrame(news, "seq long, id string, headline string, source string, ts double, body string, symbols array<string>, url string")
    alerts, _ = follow.follow(spark, items, spark.createDataFrame(then(CALM, (5, 0.97, 20000.0)), TICK))
    got = sorted(r.described for r in follow.describe(alerts).collect())
    assert got[0].startswith("[CRITICAL] unexplained_move (SYN) score=") and " :: SYN down " in got[0]
    assert got[1].startswith("[IMPORTANT] news_critical (-) score=56 :: OPEC announces surprise output cut | cat=geopolitics_supply")


def test_sinks(spark, tmp_path, capsys):
    lines = spark.createDataFrame([(0.0, 4, "US", "", "", "B", ["A"], "s", "", "news_critical", "B", "00:00:00 *(US) B"), (1.0, 1, "", "", "", "C", [], "s", "", "", " ", "00:00:01 -C")], "ts double, priority int, region string, org string, speaker string, body string, symbols array<string>, source string, url string, note string, spoken string, line string")
    sinks.append_log(lines, f"{tmp_path}/log")
    sinks.append_log(lines, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").where("iso = '1970-01-01T00:00:00Z' and priority = 'CRITICAL'").count() == 2
    sinks.terminal(colour=False)(lines, 0)
    assert capsys.readouterr().out == "00:00:00 *(US) B  [news_critical]\n00:00:01 -C\n"
    said = []

    class Said:
        def __init__(self, argv):
            said.append(argv)

        def wait(self):
            pass

    voice = sinks.Voice(start=Said, find=lambda x: x == "espeak")
    voice(lines, 0)
    voice.close()
    assert said == [["espeak", "-s", "190", "B"]]
    assert {r.priority: r.n for r in sinks.counts(lines).collect()} == {"CRITICAL": 1, "LOW": 1}


def test_a_critical_line_stops_a_lesser_one():
    done, log = {}, []

    class Slow:
        def __init__(self, argv):
            self.text, self.over = argv[-1], threading.Event()
            done[self.text] = self
            log.append(self.text)

        def wait(self):
            self.over.wait(20)

        def terminate(self):
            log.append(f"stop {self.text}")
            self.over.set()

    voice = sinks.Voice(start=Slow, find=lambda x: x == "espeak")
    voice.say("first", rules.IMPORTANT)
    while "first" not in done:
        time.sleep(0.01)
    voice.say("second", rules.IMPORTANT)
    voice.say("now", rules.CRITICAL)
    for text in ("now", "second"):
        while text not in done:
            time.sleep(0.01)
        done[text].over.set()
    voice.close()
    assert log == ["first", "stop first", "now", "second"]


def test_live_sources(monkeypatch):
    """Each feed at its own interval; bars and trades once, over a restart with the offset."""
    bodies, asked, clock = {}, [], [1000.0]

    class Canned:
        def __init__(self, state):
            self.state = state

        def get(self, url, now):
            asked.append((now, url))
            return http.Answer(200, bodies.get(url, b""))

    monkeypatch.setattr(http._FeedReader, "poller", Canned)
    monkeypatch.setattr(http._PriceReader, "poller", Canned)
    monkeypatch.setattr(http.time, "time", lambda: clock[0])
    bodies["u1"] = b"x"
    reader = http._FeedReader({"feeds": json.dumps([["a", "u1", 10.0], ["b", "u2", 60.0]])})
    offset = reader.initialOffset()
    for clock[0] in (1000.0, 1005.0, 1010.0, 1061.0):
        rows, offset = reader.read(offset)
        list(rows)
    assert asked == [(1000.0, "u1"), (1000.0, "u2"), (1010.0, "u1"), (1061.0, "u1"), (1061.0, "u2")]
    chart = lambda n: json.dumps({"chart": {"result": [{"timestamp": [60 * k for k in range(n)], "indicators": {"quote": [{"close": [None, *range(1, n)], "volume": [None] * n}]}}]}}).encode()
    options = {"symbols": json.dumps({"S": "c"}), "products": json.dumps({"P": "t"}), "since": json.dumps({"S": 60.0})}
    offset, got = http._PriceReader(options).initialOffset(), []
    for clock[0], n, trade in ((2000.0, 4, 7), (2010.0, 9, 9), (2020.0, 5, 7), (2040.0, 5, 8)):
        bodies["c"], bodies["t"] = chart(n), json.dumps({"trade_id": trade, "price": "3.5", "size": None}).encode()
        rows, offset = http._PriceReader(options).read(json.loads(json.dumps(offset)))
        got += [(s, ts, p) for s, _, ts, p, _ in rows]
    assert got == [("S", 120.0, 2.0), ("P", 2000.0, 3.5), ("S", 180.0, 3.0), ("P", 2040.0, 3.5)]
    assert http.closed_bars(b"{}") == [] and http.last_trade(b"oops") is None


def test_histogram(spark):
    df = spark.createDataFrame([(1, "below X: a"), (2, "cat=a; b"), (3, "below X: c")], "seq long, reason string")
    assert [(r.reason, r.n) for r in score.drop_histogram(df).collect()] == [("below X", 2), ("cat=a", 1)]


def test_asof_direction(spark):
    m = spark.createDataFrame([("A", 1, 10.0)], "symbol string, seq long, ts double")
    n = spark.createDataFrame([(7, 10.0, ["A", "B"]), (8, 11.0, ["A"])], "seq long, ts double, symbols array<string>")
    assert correlate.moves_with_news(m, n, 5.0).first().news.seq == 7
    assert {r.seq: r.move and r.move.seq for r in correlate.news_with_moves(n, m, 5.0).collect()} == {7: None, 8: 1}


def test_command_line(spark, tmp_path, capsys):
    from tidewire import cli

    class Canned:
        def get(self, url, now=None):
            if "federalreserve" in url:
                return http.Answer(200, RSS.replace(b"Second", b"OPEC announces surprise output cut"))
            return http.Answer(200, b"<rss><channel></channel></rss>") if "ecb" in url else http.Answer(0, error="down")

    assert cli.main(["--check"], spark, Canned()) == 20
    out = capsys.readouterr().out
    assert "Fed press" in out and "OK" in out and "EMPTY" in out and "DEAD" in out
    assert cli.main(["--replay", "--limit", "50", "--min-priority", "NORMAL"], spark, Canned()) == 0
    out = capsys.readouterr().out
    assert "(OPEC) ANNOUNCES SURPRISE OUTPUT CUT" in out and "duplicate of" in out and "no market-relevant category matched" in out


def test_live_tape(spark, tmp_path):
    """What the stream emits has what a tape line needs."""
    ticks = spark.createDataFrame(then(CALM, (5, 0.97, 20000.0)), TICK)
    items = spark.createDataFrame([(1, "OPEC announces surprise output cut", "reuters", 0.0)], "seq long, headline string, source string, ts double")
    live.configure(spark)
    ticks.write.parquet(f"{tmp_path}/t")
    items.write.parquet(f"{tmp_path}/i")
    seen = []

    def write(batch, n):
        item = F.when(F.col("headline").isNotNull(), F.struct("headline", "source", F.lit("").alias("url")))
        move = F.when(F.col("symbol").isNotNull(), F.struct("symbol", *live.SIZE))
        seen.extend(r.body for r in follow.tape(batch.select("kind", "priority", "ts", "reason", "symbols", item.alias("item"), move.alias("move"))).collect())

    read = lambda n, df: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{n}")
    live.observed(live.live_alerts(read("i", items), read("t", ticks))).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen)[0] == "ANNOUNCES SURPRISE OUTPUT CUT" and sorted(seen)[1].startswith("SYN ▼ ") and seen[-1] != ""
