"""Headlines, ticks, feeds and payloads made from the driver's tables, for queries and their SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..storage import spread

#: Headlines with a number to fill in. ASCII, so that all engines' word classes agree.
TEMPLATES = (
    "Fed Chair Warsh says central bank may raise rates by {n} basis points",
    "OPEC+ announces surprise production cut of {n} million barrels per day",
    "US CPI rose {n}.4% m/m vs expectations of 0.2%, prior 0.3%",
    "Nonfarm payrolls came in at {n} vs 165 expected",
    "BREAKING: ECB's Lagarde said the policy statement was not hawkish - Reuters",
    "Acme Corp (ACME) cuts guidance after {n} percent drop in orders",
    "Ukrainian strikes halt shipments from Russian grain ports for {n} days",
    "3 reasons Globex could be poised to benefit from new rules",
    "Week ahead: what to watch in markets",
    "Initech (INIT) to acquire Hooli (HOOL) in $ {n} billion all-cash offer",
    "Treasury official appoints {n} members to advisory council on sanctions",
    "Podcast: key takeaways from the jobs report",
    "Tokyo lifts tariffs on {n} imports, Japan confirms",
    "UK gilt yields jump {n} bps as gross domestic product beats forecasts",
    "Federal Reserve Board announces approval of the application by {n} banks",
    "Fed's Williams: rate cut of {n} bps would be premature this year",
    "Data breach at Umbrella Inc (UMB) hits {n} million users",
    "Retail sales fell {n}.2% versus forecast of 1.1% y/y",
    "China bans exports: export ban on {n} metals, embargo to follow",
    "Opinion: how to read the yield curve control debate",
    "Chapter 11 filing: Vandelay files for bankruptcy owing $2.5 trillion, says counterparty",
    "Markets close mixed in quiet trade",
    "ISM services at {n}.5 vs. exp. 51.2 prev. 50.8",
    "UPDATE {n}: Bank of Canada's Macklem told CNBC that inflation risks are balanced",
)
SOURCES = ("reuters", "Bloomberg News", "cnbc", "blog.example", "federalreserve.gov", "ecb", "Yahoo Finance", "investing.com", "unknown wire", "x.com/user", "guardian", "bls.gov")
NOW = 899_000_000.0
"""A fixed present for queries that let headlines age."""


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def epoch(col) -> F.Column:
    """Epoch seconds of a time without zone, taken as UTC."""
    return F.unix_micros(F.col(col).cast("timestamp")) / 1e6


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, headline, source, ts: one for every row of lineitem."""
    n = len(TEMPLATES)
    filled = F.replace(_pick(TEMPLATES, F.pmod(F.col("l_orderkey") * 3 + F.col("l_linenumber") + F.col("l_suppkey"), F.lit(n))), F.lit("{n}"), F.col("l_quantity").cast("int").cast("string"))
    return spread(spark, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), filled.alias("headline"), _pick(SOURCES, F.pmod(F.col("l_partkey"), F.lit(len(SOURCES)))).alias("source"), epoch("l_shipdate").alias("ts")
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items (seq, id, headline, source, ts, body, symbols, url): one for every order, at times spread over its day."""
    kinds = ("click", "view", "purchase", "signup", "login")
    rows = spread(spark, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    filled = F.replace(_pick(TEMPLATES, F.pmod(F.col("o_orderkey") * 5 + F.col("o_custkey"), F.lit(len(TEMPLATES)))), F.lit("{n}"), (F.col("o_custkey") % 50 + 1).cast("string"))
    return rows.select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("id"), filled.alias("headline"), _pick(SOURCES, F.pmod(F.col("o_custkey"), F.lit(len(SOURCES)))).alias("source"),
        (epoch("o_orderdate") + F.pmod(F.col("o_orderkey") * 7919, F.lit(86400))).alias("ts"), F.lit("").alias("body"), F.array(_pick(kinds, F.pmod("o_orderkey", F.lit(5)))).alias("symbols"), F.lit("").alias("url"),
    )


_LIST = lambda v: "[" + ", ".join(quote(x) for x in v) + "]"
HEADLINES_SQL = f"""
h AS (
  SELECT l_orderkey * 8 + l_linenumber AS seq,
         replace({_LIST(TEMPLATES)}[1 + (l_orderkey * 3 + l_linenumber + l_suppkey) % {len(TEMPLATES)}], '{{n}}', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS headline,
         {_LIST(SOURCES)}[1 + l_partkey % {len(SOURCES)}] AS source, epoch(l_shipdate) AS ts
  FROM lineitem
)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, ts, price, volume of events."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), epoch("ts").alias("ts"), F.col("value").alias("price"), F.coalesce(k, F.lit(0.0)).alias("volume"))


TICKS_SQL = """
t AS (
  SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS ts, value AS price,
         coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS volume
  FROM events
)"""

MOVES = rules.MoveConfig(windows_s=(21600.0, 86400.0), min_z=1.5, min_abs_ret=0.5, hard_ret=50.0, min_volume_ratio=1.2, cooldown_s=43200.0, history_s=864000.0)
"""Events are minutes to hours apart, so windows, history and cooldown are in hours and days."""


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, headline: the whole text of every document, a minute apart."""
    docs = spread(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("seq"), (F.col("doc_id") * 60.0).alias("ts"), F.coalesce("text", F.lit("")).alias("headline"))


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, body: an RSS feed for every supplier, every third an Atom feed; each with two items, one undated or untitled."""
    key, name = F.col("s_suppkey").cast("string"), F.col("s_name")
    rss = F.concat(
        F.lit("<rss version=\"2.0\"><channel><title>x</title><item><title>"), name, F.lit(" &amp;lt;b&amp;gt; up</title><link>http://e.example/"), key,
        F.lit("</link><guid>g"), key, F.lit("</guid><pubDate>Sat, 29 Aug 2026 10:30:00 -0400</pubDate><description>&lt;p&gt;Body  of "), key,
        F.lit("&lt;/p&gt;</description></item><item><title></title><pubDate>Sat, 29 Aug 2026 10:31:00 GMT</pubDate></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>x</title><entry><title>"), name, F.lit("</title><link href=\"http://a.example/"), key,
        F.lit("\"/><id>a"), key, F.lit("</id><updated>2026-08-29T10:30:00-04:00</updated><summary>S "), key, F.lit("</summary></entry><entry><title>No date "), key, F.lit("</title></entry></feed>"),
    )
    body = F.when(F.col("s_suppkey") % 3 == 0, atom).when(F.col("s_suppkey") % 10 == 7, F.lit("<rss><broken")).otherwise(rss)
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("feed"), key).alias("source"), body.alias("body"))
