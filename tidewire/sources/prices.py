"""Price payloads to ticks."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CHART = "chart struct<result: array<struct<timestamp: array<double>, indicators: struct<quote: array<struct<close: array<double>, volume: array<double>>>>>>>"
_TICKER = "price string, trade_id string, size string"


def bars(payloads: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """payloads (symbol, body) of one-minute bars to (symbol, seq, ts, price, volume).

    The last bar is still forming and held back; bars without a close are left out, those without a volume have 0. last
    (symbol, ts) has what was already given out: only later bars follow. Bodies that aren't such JSON give nothing.
    """
    first = F.get(F.from_json(F.col("body").cast("string"), _CHART)["chart"]["result"], F.lit(0))
    quote = F.get(first["indicators"]["quote"], F.lit(0))
    df = payloads.select("symbol", first["timestamp"].alias("t"), quote["close"].alias("close"), quote["volume"].alias("volume"))
    stamps = F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))
    rows = df.where("t is not null and close is not null").select("symbol", F.posexplode(stamps).alias("seq", "ts"), "close", "volume")
    rows = rows.select("symbol", F.col("seq").cast("long").alias("seq"), "ts", F.get("close", F.col("seq")).alias("price"), F.coalesce(F.get("volume", F.col("seq")), F.lit(0.0)).alias("volume"))
    rows = rows.where("price is not null and ts is not null")
    if last is not None:
        rows = rows.join(last.select("symbol", F.col("ts").alias("_since")), "symbol", "left").where("_since is null or ts > _since").drop("_since")
    return rows


def tickers(payloads: DataFrame) -> DataFrame:
    """payloads (symbol, seq, now, body) of a ticker to (symbol, seq, ts, price, volume). A trade that the poll before it had
    already is left out; trades without an id never are. The time is that of the poll."""
    x = F.from_json(F.col("body").cast("string"), _TICKER)
    df = payloads.select("symbol", "seq", F.col("now").alias("ts"), x["price"].try_cast("double").alias("price"), F.coalesce(x["trade_id"], F.lit("0")).try_cast("long").alias("trade"), F.coalesce(x["size"], F.lit("0")).try_cast("double").alias("volume"))
    df = df.where("price is not null and trade is not null and volume is not null")
    before = F.lag("trade").over(Window.partitionBy("symbol").orderBy("seq"))
    return df.withColumn("_before", before).where("trade = 0 or _before is null or trade != _before").select("symbol", "seq", "ts", "price", "volume")


def walk(n: int, symbol: str = "SYN", step_s: float = 5.0, start: float = 0.0, price: float = 100.0, shock_at: int | None = None, shock: float = 0.97, seed: int = 7) -> list[tuple]:
    """Made-up ticks (symbol, seq, ts, price, volume): a calm random walk with one shock, for demonstrations and tests."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        price *= math.exp(r.gauss(0, 0.0004))
        volume = r.uniform(800, 1200)
        if k == shock_at:
            price, volume = price * shock, volume * 12
        out.append((symbol, k, start + k * step_s, price, volume))
    return out
