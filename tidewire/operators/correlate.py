"""Join news and moves of one symbol within a time, in order of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _last_before(rows: DataFrame, other: DataFrame, order: int, name: str) -> DataFrame:
    """rows (symbol, ts, seq, ...) with the latest row of other (symbol, ts, seq, ...) that comes before, as a struct.

    An as-of join as one union and one window over symbol: one exchange, streaming frames. At equal times news comes
    before moves (order: 0 if rows are news, 1 if moves).
    """
    left = rows.select(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts"), F.lit(order).alias("_kind"), F.col("seq").alias("_seq"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(other.select(F.struct(*other.columns)).schema[0].dataType).alias("_other"))
    right = other.select(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts"), F.lit(1 - order).alias("_kind"), F.col("seq").alias("_seq"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_row"), F.struct(*other.columns).alias("_other"))
    by = Window.partitionBy("_symbol").orderBy("_ts", "_kind", "_seq").rowsBetween(Window.unboundedPreceding, -1)
    met = left.unionByName(right).withColumn(name, F.last("_other", ignorenulls=True).over(by)).where("_row is not null")
    return met.select("_row.*", name)


def moves_with_news(moves: DataFrame, news: DataFrame, within_s: float) -> DataFrame:
    """moves (symbol, ts, seq, ...) with news: the latest news (symbols, ts, seq, ...) of the symbol before it, if at most
    within_s old, else null. There is no lower bound: news dated ahead of the move counts."""
    by_symbol = news.withColumn("symbol", F.explode(F.array_distinct("symbols")))
    met = _last_before(moves, by_symbol, 1, "news")
    return met.withColumn("news", F.when(F.col("ts") - F.col("news.ts") <= within_s, F.col("news")))


def news_with_moves(news: DataFrame, moves: DataFrame, within_s: float) -> DataFrame:
    """news (symbols, ts, seq, ...) with move: of its symbols in order the first whose latest earlier move is at most
    within_s old; null if none is."""
    by_symbol = news.select("seq", "ts", F.posexplode("symbols").alias("pos", "symbol"))
    met = _last_before(by_symbol, moves, 0, "move").where(F.col("ts") - F.col("move.ts") <= within_s)
    first = met.groupBy("seq").agg(F.min_by("move", "pos").alias("move"))
    return news.join(first, "seq", "left")
