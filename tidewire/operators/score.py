"""Score headlines: market relevance from categories, surprise, magnitude, noise, source and age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as T
from ..storage import by_distinct


def priority_name(priority: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in rules.PRIORITY_NAMES]), priority + 1)


def _read(items: DataFrame, categories) -> DataFrame:
    """items with what their texts alone say: the phrases of each table, and the magnitude."""
    text = items.withColumn("_text", F.lower(T.item_text(F.col("headline"), F.col("body"))))
    df = text.withColumns(
        {
            "_boiler": T.phrase_hits(F.col("_text"), rules.BOILERPLATE),
            "_hits": F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.size(T.phrase_hits(F.col("_text"), p)).alias("n")) for n, w, p in categories]),
            "_surprise": T.phrase_hits(F.col("_text"), rules.SURPRISE),
            "_noise": T.phrase_hits(F.col("_text"), rules.NOISE),
            "_admin": T.phrase_hits(F.col("_text"), rules.ADMIN),
            "_magnitude": T.magnitude(F.col("_text")),
        }
    )
    return T.once(df).withColumn("_hits", F.filter("_hits", lambda h: h["n"] > 0)).drop("_text")


def score_news(items: DataFrame, cfg: rules.NewsConfig | None = None, now: Column | None = None, categories=rules.CATEGORIES) -> DataFrame:
    """items (headline, source, ts; body and symbols if there) with all_symbols, score, priority, categories, magnitude and
    reason. now: epoch seconds against which a headline's age counts; by default its own time, so that nothing is stale.

    Native columns; phrases are searched plainly before any pattern runs, and once a text where texts repeat much.
    """
    cfg = cfg or rules.NewsConfig()
    for name, kind in (("body", "string"), ("symbols", "array<string>")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    now = F.col("ts") if now is None else now
    df = by_distinct(items, ["headline", "body"], lambda x: _read(x, categories))
    df = df.withColumns({"_weight": T.source_weight(F.col("source")), "_age": F.greatest(F.lit(0.0), now - F.col("ts")), "all_symbols": T.symbols(F.col("symbols"), F.col("headline"))})
    base = F.array_max(F.transform("_hits", lambda h: h["weight"] + F.least(F.lit(6.0), 2.0 * (h["n"] - 1))))
    some = lambda c: F.size(c) > 0
    raw = (
        base
        + F.when(some("_surprise"), float(rules.SURPRISE_BONUS)).otherwise(0.0)
        + F.col("_magnitude.bonus")
        - rules.NOISE_PENALTY * F.least(F.lit(2), F.size("_noise"))
        - F.when(some("_admin"), float(rules.ADMIN_PENALTY)).otherwise(0.0)
        + 6.0 * (F.size("_hits") - 1)
    )
    fresh = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * F.col("_weight") * (1.0 - F.col("_age") / cfg.max_age_s * 0.5)))
    if cfg.watchlist:
        watched = F.arrays_overlap("all_symbols", F.array(*[F.lit(s) for s in cfg.watchlist]))
        fresh = F.when(watched, F.least(F.lit(100.0), fresh + cfg.watchlist_bonus)).otherwise(fresh)
    df = df.withColumn("_state", F.when(some("_boiler"), "boilerplate").when(~some("_hits"), "none").when(F.col("_age") >= cfg.max_age_s, "stale").otherwise("scored"))
    scored = F.col("_state") == "scored"
    df = df.withColumn("score", F.when(scored, fresh).otherwise(0.0))
    level = F.when(F.col("score") >= cfg.critical, rules.CRITICAL).when(F.col("score") >= cfg.important, rules.IMPORTANT).when(F.col("score") >= cfg.emit, rules.NORMAL).otherwise(rules.LOW)
    minutes = T.fixed(F.col("_age") / 60, 0)
    names = F.transform("_hits", lambda h: h["name"])
    reason = F.concat_ws(
        "; ",
        F.concat(F.lit("cat="), F.array_join(names, "+")),
        F.concat(F.lit("src x"), T.fixed(F.col("_weight"), 2)),
        F.when(some("_surprise"), F.concat(F.lit("surprise:"), F.get("_surprise", 0))),
        F.when(F.col("_magnitude.bonus") != 0, F.concat(F.lit("magnitude+"), T.fixed(F.col("_magnitude.bonus"), 0))),
        F.when(some("_noise"), F.concat(F.lit("noise:"), F.array_join(F.slice("_noise", 1, 2), ","))),
        F.when(some("_admin"), F.concat(F.lit("admin:"), F.get("_admin", 0))),
        F.when(F.col("_age") > 60, F.concat(F.lit("age "), minutes, F.lit("m"))),
    )
    none = F.expr("cast(array() as array<string>)")
    out = df.withColumns(
        {
            "priority": F.when(scored, level).otherwise(rules.DROP),
            "categories": F.when(F.col("_state").isin("scored", "stale"), names).otherwise(none),
            "magnitude": F.when(F.col("_state").isin("scored", "stale"), F.col("_magnitude.largest")).otherwise(0.0),
            "reason": F.when(F.col("_state") == "boilerplate", F.concat(F.lit("boilerplate: "), F.get("_boiler", 0)))
            .when(F.col("_state") == "none", "no market-relevant category matched")
            .when(F.col("_state") == "stale", F.concat(F.lit("stale ("), minutes, F.lit("m old)")))
            .otherwise(reason),
        }
    ).drop("_boiler", "_hits", "_surprise", "_noise", "_admin", "_magnitude", "_weight", "_age", "_state")
    return T.once(out)


def relevant(scored: DataFrame) -> DataFrame:
    """What goes on to deduplication."""
    return scored.where(F.col("priority") >= rules.NORMAL)


def drop_histogram(dropped: DataFrame, top: int = 8, reason: str = "reason", order: str = "seq") -> DataFrame:
    """(reason, n, first_seen) of the most frequent reasons for a drop, up to a first colon and semicolon; of reasons as
    frequent the first seen leads."""
    key = F.trim(F.substring_index(F.substring_index(F.col(reason), ":", 1), ";", 1))
    counted = dropped.groupBy(key.alias("reason")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(top)
