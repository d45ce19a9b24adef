"""The follower in batch: headlines and ticks in, alerts and what was dropped out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import release as R
from ..functions import squawk as S
from ..functions import text as T
from ..storage import stored
from . import correlate, dedup, moves, score

ITEM = ("id", "headline", "source", "ts", "body", "url")
MOVE = ("symbol", "ts", "ret", "window_s", "sigma", "z", "volume_ratio", "price_from", "price_to", "reversal")


def follow(spark: SparkSession, items: DataFrame, ticks: DataFrame, cfg: rules.FollowConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(alerts, dropped).

    items: seq, id, headline, source, ts, body, symbols, url; ticks: symbol, seq, ts, price, volume. Events count in order of
    time, news before ticks, then seq. Headlines are scored at their own time, gated at NORMAL, deduplicated, remembered by
    symbol, and either confirmed by a move, gated at min_priority, or dropped. Moves are confirmed by news or unexplained.
    """
    cfg = cfg or rules.FollowConfig()
    detect = lambda: stored(spark, moves.quick_moves(ticks, cfg.move), "moves")
    with ThreadPoolExecutor(1) as beside:  # a symbol is one task, so few symbols leave most cores to the headlines
        moving = beside.submit(inheritable_thread_target(spark)(copy_context().run), detect)
        scored = stored(spark, score.score_news(items, cfg.news), "scored")
        fresh = stored(spark, dedup.deduplicate(spark, score.relevant(scored), cfg.news), "deduplicated")
        found = moving.result()
    kept = fresh.where("duplicate_of is null").withColumn("symbols", F.col("all_symbols"))
    said = lambda m: moves.describe(F.col(f"{m}symbol"), F.col(f"{m}ret"), F.col(f"{m}window_s"), F.col(f"{m}z"), F.col(f"{m}volume_ratio"))
    no_move = F.lit(None).cast(found.select(F.struct(*MOVE)).schema[0].dataType)
    no_item = F.lit(None).cast(kept.select(F.struct(*ITEM)).schema[0].dataType)

    news = stored(spark, correlate.news_with_moves(kept, found, cfg.correlate_s), "news")
    confirmed = F.col("move").isNotNull()
    emitted = news.where(confirmed | (F.col("priority") >= cfg.min_priority)).select(
        F.when(confirmed, "confirmed").otherwise("news_critical").alias("kind"), F.when(confirmed, rules.CRITICAL).otherwise(F.col("priority")).alias("priority"), "ts",
        F.when(confirmed, F.least(F.lit(100.0), F.col("score") + 10)).otherwise(F.col("score")).alias("score"),
        F.when(confirmed, F.concat("reason", F.lit("; price already moved: "), said("move."))).otherwise(F.col("reason")).alias("reason"),
        "symbols", F.struct(*ITEM).alias("item"), F.when(confirmed, F.struct(*[F.col(f"move.{c}").alias(c) for c in MOVE])).alias("move"),
    )
    moved = correlate.moves_with_news(found, kept, cfg.correlate_s)
    explained = F.col("news").isNotNull()
    from_moves = moved.select(
        F.when(explained, "confirmed").otherwise("unexplained_move").alias("kind"),
        F.when(explained | (F.abs("ret") >= cfg.move.hard_ret), rules.CRITICAL).otherwise(rules.IMPORTANT).alias("priority"), "ts",
        F.when(explained, F.least(F.lit(100.0), F.col("news.score") + 10)).otherwise(F.least(F.lit(100.0), 45 + 4 * F.col("z") + 400 * F.abs("ret"))).alias("score"),
        F.when(explained, F.concat(said(""), F.lit(" on: "), F.col("news.headline"))).otherwise(F.concat(said(""), F.lit(" with no matching headline"), F.when(F.col("reversal"), " (reversal)").otherwise(""))).alias("reason"),
        F.array("symbol").alias("symbols"), F.when(explained, F.struct(*[F.col(f"news.{c}").alias(c) for c in ITEM])).otherwise(no_item).alias("item"), F.struct(*MOVE).alias("move"),
    )
    first = fresh.where("duplicate_of is not null").join(kept.select(F.col("seq").alias("duplicate_of"), F.col("headline").alias("of")), "duplicate_of")
    low = news.where(~confirmed & (F.col("priority") < cfg.min_priority))
    dropped = (
        scored.where(F.col("priority") < rules.NORMAL).select("seq", "headline", "reason")
        .union(first.select("seq", "headline", F.concat(F.lit("duplicate of: "), "of")))
        .union(low.select("seq", "headline", F.concat(F.lit(f"below {rules.PRIORITY_NAMES[cfg.min_priority]}: "), "reason")))
    )
    return emitted.unionByName(from_moves), dropped


def tape(alerts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Alerts as tape lines: ts, priority, region, org, speaker, body, symbols, source, url, note, spoken, line.

    Releases show actual against expected and may raise the line's priority, other headlines are compressed prose, moves
    show size and speed. sources (key, region), if given, supplies default regions.
    """
    df = alerts
    if sources is not None:
        df = df.join(F.broadcast(sources.groupBy(F.col("key").alias("_key")).agg(F.first("region").alias("_region"))), F.col("item.source") == F.col("_key"), "left")
    default = F.coalesce(F.col("_region"), F.lit("")) if sources is not None else F.lit("")
    df = df.withColumns({"headline": F.coalesce("item.headline", F.lit("")), "source": F.coalesce("item.source", F.lit(""))})
    df = T.once(df.withColumn("_indicator", R.indicator(F.col("headline"))))
    df = T.once(df.withColumn("_release", F.when(F.col("_indicator") != "", R.parse(F.col("headline"), F.col("_indicator")))))
    df = S.with_tape_line(df, default)
    release = F.col("_release")
    is_news, is_release = F.col("headline") != "", release.isNotNull()
    # A move that a headline explains is told by the headline.
    move = moves.move_line(F.col("move.symbol"), F.col("move.ret"), F.col("move.window_s"), F.col("move.z"), F.col("kind") == "unexplained_move")
    body = F.when(is_news & is_release, R.body(release)).when(is_news, F.col("body")).otherwise(move)
    own = R.priority(release["indicator"], release["actual"], release["expected"])
    out = df.select(
        "ts", F.when(is_news & is_release, F.greatest("priority", own)).otherwise(F.col("priority")).alias("priority"),
        *[F.when(is_news, F.col(c)).otherwise("").alias(c) for c in ("region", "org", "speaker")], body.alias("body"), "symbols",
        F.coalesce("item.source", F.lit("tape")).alias("source"), F.coalesce("item.url", F.lit("")).alias("url"), F.col("kind").alias("note"),
    )
    out = T.once(out)
    return out.withColumns({"spoken": S.spoken(F.col("body"), F.col("region")), "line": S.render(F.col("body"), F.col("region"), F.col("priority"), F.col("ts"))})


def describe(alerts: DataFrame) -> DataFrame:
    """alerts with described: [PRIORITY] kind (SYMBOLS) score=N :: headline or move | reason"""
    move = moves.describe(*[F.col(f"move.{c}") for c in ("symbol", "ret", "window_s", "z", "volume_ratio")])
    names = F.when(F.size("symbols") > 0, F.array_join("symbols", ",")).otherwise("-")
    text = F.concat(
        F.lit("["), score.priority_name(F.col("priority")), F.lit("] "), F.col("kind"), F.lit(" ("), names, F.lit(") score="), T.fixed(F.col("score"), 0),
        F.lit(" :: "), F.coalesce("item.headline", move, F.lit("")), F.lit(" | "), F.col("reason"),
    )
    return alerts.withColumn("described", text)


def replay(spark: SparkSession, items: DataFrame, min_priority: int = rules.NORMAL, watchlist: tuple[str, ...] = (), limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """(tape lines, drop histogram) of the latest `limit` headlines (0: all), with staleness off and no ticks."""
    if limit:
        items = items.orderBy(F.desc("ts"), F.desc("seq")).limit(limit)
    cfg = rules.FollowConfig(news=rules.NewsConfig(watchlist=watchlist, max_age_s=float("inf")), min_priority=min_priority)
    ticks = spark.createDataFrame([], "symbol string, seq long, ts double, price double, volume double")
    alerts, dropped = follow(spark, items, ticks, cfg)
    return tape(alerts), score.drop_histogram(dropped)


def speech_order(lines: DataFrame, min_priority: int = rules.IMPORTANT) -> DataFrame:
    """What a voice would read, most urgent first and then in order of arrival."""
    return lines.where((F.col("priority") >= min_priority) & (F.trim("spoken") != "")).orderBy(F.desc("priority"), "seq")


def recent(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The last k rows by (ts, seq) of each key: what a ring buffer of k holds."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("seq"))
    return rows.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k).drop("_n")


def latest(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows by (ts, seq), in that order."""
    return rows.orderBy(F.desc("ts"), F.desc("seq")).limit(n).orderBy("ts", "seq")
