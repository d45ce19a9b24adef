"""Command line: check the feeds, replay what they hold now, or run live."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rules
from .operators import follow
from .sources import feeds, prices, registry
from .sources.http import FeedSource, Poller, PriceSource
from .streaming import live, sinks

CHART = "https://query1.finance.yahoo.com/v8/finance/chart/{}?range=1d&interval=1m"
TICKER = "https://api.exchange.coinbase.com/products/{}/ticker"
PRODUCTS = ("BTC-USD", "ETH-USD")
SYMBOLS = ("^GSPC", "^NDX", "^VIX", "^TNX", "CL=F", "GC=F", "ZW=F", "DX-Y.NYB")
PRICE_POLL_S = 20


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewire", description=__doc__)
    p.add_argument("--check", action="store_true", help="poll every registered feed once and report")
    p.add_argument("--replay", action="store_true", help="run what the feeds hold now through the filter, without staleness")
    p.add_argument("--limit", type=int, default=0, help="latest headlines to replay; 0: all")
    p.add_argument("--duration", type=float, default=0, help="seconds to run live; 0: until stopped")
    p.add_argument("--prime", type=float, default=6.0, help="seconds of the first poll, whose headlines aren't reported")
    p.add_argument("--speak", action="store_true", help="read urgent lines out")
    p.add_argument("--primary-only", action="store_true", help="publishers of record only")
    p.add_argument("--min-priority", choices=rules.PRIORITY_NAMES[1:], default="IMPORTANT")
    p.add_argument("--symbols", default="", help="comma-separated symbols to watch; default: the index complex, rates, energy, grain, gold, dollar")
    p.add_argument("--watchlist", default="", help="comma-separated symbols whose headlines count for more")
    p.add_argument("--log", default="", help="folder of JSON lines to append to")
    return p


def split(s: str) -> tuple[str, ...]:
    return tuple(x.strip().upper() for x in s.split(",") if x.strip())


def poll(spark: SparkSession, sources: DataFrame, poller: Poller) -> tuple[DataFrame, DataFrame]:
    """(bodies, counts) of one poll of every source; a registry has a few dozen."""
    rows, counts = [], []
    for s in sources.toLocalIterator():
        a = poller.get(s["url"])
        rows += [(s["key"], s["name"], bytearray(a.body))] if a.ok else []
        counts.append((s["name"], a.ok))
    bodies = spark.createDataFrame(rows, "source string, name string, body binary")
    return bodies, spark.createDataFrame(counts, "name string, answered boolean")


def check(spark: SparkSession, poller: Poller) -> DataFrame:
    """Health of every registered source."""
    sources = registry.sources(spark)
    bodies, answered = poll(spark, sources, poller)
    n = feeds.parse_feeds(bodies.select(F.col("name").alias("source"), "body")).groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return registry.health(sources, answered.join(n, "name", "left").fillna(0, ["n"]))


def numbered(items: DataFrame) -> DataFrame:
    """items with seq, their place in order of time; one poll of the registry is a few thousand rows."""
    return items.withColumn("seq", F.row_number().over(Window.orderBy("ts", "source", "pos")).cast("long"))


def bars(spark: SparkSession, symbols: Sequence[str], poller: Poller) -> DataFrame:
    got = [(s, bytearray(a.body)) for s in symbols if (a := poller.get(CHART.format(quote(s, safe="")))).ok]
    return prices.bars(spark.createDataFrame(got, "symbol string, body binary"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, poller: Poller | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidewire").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    poller = poller or Poller()
    level, watch = rules.PRIORITY_NAMES.index(args.min_priority), split(args.watchlist)
    show = sinks.terminal()
    if args.check:
        report = check(spark, poller).orderBy("name").collect()
        for r in report:
            print(f"{r['name']:34} {r['status']:6} {r['n']:4d} items")
        return sum(r["failure"] for r in report)
    sources = registry.sources(spark, live_only=True, primary_only=args.primary_only)
    if args.replay:
        bodies, _ = poll(spark, sources, poller)
        lines, reasons = follow.replay(spark, numbered(feeds.parse_feeds(bodies.select("source", "body"))), level, watch, args.limit)
        show(lines, 0)
        for r in reasons.collect():
            print(f"  {r['n']:4d}  {r['reason']}")
        return 0
    return run(spark, args, sources, poller, level, watch)


def run(spark: SparkSession, args, sources: DataFrame, poller: Poller, level: int, watch: tuple[str, ...]) -> int:
    """The live service: feeds and bars as streams, alerts to the terminal, the log and the voice."""
    live.configure(spark)
    for source in (FeedSource, PriceSource):
        spark.dataSource.register(source)
    polled = [(s["key"], s["url"], s["poll_s"]) for s in sources.toLocalIterator()]
    began = time.time() + args.prime
    items = live.new_items(spark.readStream.format("feeds").option("feeds", json.dumps(polled)).load()).where(F.col("ts") >= began - 1800)
    items = items.withColumn("seq", F.floor(F.col("ts") * 1000).cast("long"))
    symbols = split(args.symbols) or SYMBOLS
    backlog = bars(spark, symbols, poller)
    since = {r["symbol"]: r["ts"] for r in backlog.groupBy("symbol").agg(F.max("ts").alias("ts")).collect()}
    prices_in = spark.readStream.format("prices").option("poll_s", PRICE_POLL_S).option("since", json.dumps(since))
    ticks = prices_in.option("symbols", json.dumps({x: CHART.format(quote(x, safe="")) for x in symbols})).option("products", json.dumps({x: TICKER.format(x) for x in PRODUCTS})).load()
    cfg = rules.FollowConfig(news=rules.NewsConfig(watchlist=watch), min_priority=level)
    show, say = sinks.terminal(), sinks.Voice() if args.speak else None

    def write(batch: DataFrame, n: int) -> None:
        if time.time() < began:
            return  # what the feeds already held
        item = F.when(F.col("headline").isNotNull(), F.struct("headline", "source", F.lit("").alias("url")))
        move = F.when(F.col("symbol").isNotNull(), F.struct("symbol", *live.SIZE))
        lines = follow.tape(batch.select("kind", "priority", "ts", "reason", "symbols", item.alias("item"), move.alias("move")), sources)
        show(lines, n)
        if args.log:
            sinks.append_log(lines, args.log)
        if say:
            say(lines, n)

    print(sinks.banner(len(polled), len(symbols) + len(PRODUCTS), args.min_priority))
    counter = sinks.Counter()
    spark.streams.addListener(counter)
    q = live.observed(live.live_alerts(items, ticks, cfg, backlog)).writeStream.foreachBatch(write).trigger(processingTime="5 seconds").start()
    try:
        q.awaitTermination(int(args.duration) or None)
    except KeyboardInterrupt:
        pass
    q.stop()
    spark.streams.removeListener(counter)
    if say:
        say.close()
    print(counter.summary())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
