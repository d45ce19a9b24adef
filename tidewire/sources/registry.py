"""The registry of feeds, as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, name string, url string, poll_s double, region string, primary boolean, reachable boolean, note string"

_CONTACT = "answers 403 unless a contact address is sent"
_CNBC = "https://search.cnbc.com/rs/search/combinedcms/view.xml?partnerId=wrss01&id="
# Key, name, address, seconds between polls, region, whether it is the publisher of record, reachable, note.
SOURCES = (
    ("federalreserve.gov", "Fed press", "https://www.federalreserve.gov/feeds/press_all.xml", 10.0, "US", True, True, ""),
    ("federalreserve.gov", "Fed speeches", "https://www.federalreserve.gov/feeds/speeches.xml", 15.0, "US", True, True, ""),
    ("ecb", "ECB press", "https://www.ecb.europa.eu/rss/press.html", 15.0, "EU", True, True, ""),
    ("boe", "Bank of England news", "https://www.bankofengland.co.uk/rss/news", 20.0, "UK", True, True, ""),
    ("boe", "Bank of England publications", "https://www.bankofengland.co.uk/rss/publications", 60.0, "UK", True, True, ""),
    ("bls.gov", "BLS releases", "https://www.bls.gov/feed/bls_latest.rss", 10.0, "US", True, True, _CONTACT),
    ("census.gov", "Census economic indicators", "https://www.census.gov/economic-indicators/indicator.xml", 30.0, "US", True, True, ""),
    ("sec.gov", "SEC EDGAR 8-K", "https://www.sec.gov/cgi-bin/browse-edgar?action=getcurrent&type=8-K&company=&dateb=&owner=include&count=40&output=atom", 20.0, "US", True, True, _CONTACT),
    ("nasdaqtrader", "Nasdaq trade halts", "https://www.nasdaqtrader.com/rss.aspx?feed=tradehalts", 10.0, "US", True, True, ""),
    ("eia.gov", "EIA Today in Energy", "https://www.eia.gov/rss/todayinenergy.xml", 60.0, "US", True, True, ""),
    ("cnbc", "CNBC top news", _CNBC + "100003114", 15.0, "", False, True, ""),
    ("cnbc", "CNBC economy", _CNBC + "20910258", 20.0, "", False, True, ""),
    ("cnbc", "CNBC finance", _CNBC + "10000664", 30.0, "", False, True, ""),
    ("cnbc", "CNBC earnings", _CNBC + "15839135", 30.0, "", False, True, ""),
    ("marketwatch", "MarketWatch real-time", "https://feeds.content.dowjones.io/public/rss/mw_realtimeheadlines", 15.0, "", False, True, ""),
    ("marketwatch", "MarketWatch top stories", "https://feeds.content.dowjones.io/public/rss/mw_topstories", 30.0, "", False, True, ""),
    ("ft", "FT home", "https://www.ft.com/rss/home", 60.0, "", False, True, ""),
    ("yahoo", "Yahoo Finance", "https://finance.yahoo.com/news/rssindex", 30.0, "", False, True, ""),
    ("investing.com", "Investing.com", "https://www.investing.com/rss/news.rss", 30.0, "", False, True, ""),
    ("bbc", "BBC Business", "https://feeds.bbci.co.uk/news/business/rss.xml", 60.0, "UK", False, True, ""),
    ("guardian", "Guardian Business", "https://www.theguardian.com/uk/business/rss", 60.0, "UK", False, True, ""),
    ("nytimes", "NYT Business", "https://rss.nytimes.com/services/xml/rss/nyt/Business.xml", 60.0, "US", False, True, ""),
    ("reuters", "Reuters business", "https://feeds.reuters.com/reuters/businessNews", 30.0, "", False, False, "its public feed is retired"),
    ("usda", "USDA releases", "https://www.usda.gov/rss/latest-releases.xml", 60.0, "US", True, False, "answers 403 to anything but browsers"),
)


def sources(spark: SparkSession, live_only: bool = False, primary_only: bool = False) -> DataFrame:
    """All registered sources, or the reachable ones, or the publishers of record among these."""
    df = spark.createDataFrame(SOURCES, SCHEMA)
    if live_only or primary_only:
        df = df.where("reachable")
    return df.where("primary") if primary_only else df


def health(registry: DataFrame, counts: DataFrame) -> DataFrame:
    """registry with n (items parsed, of counts by name) and status: OK, EMPTY (answered, no items), FAIL (no answer) or DEAD
    (known to be), and failure, which the latter isn't."""
    n = counts.groupBy("name").agg(F.sum("n").alias("n"), F.max("answered").alias("answered"))
    df = registry.join(n, "name", "left")
    answered = F.coalesce("answered", F.lit(False))
    status = F.when(answered & (F.coalesce("n", F.lit(0)) > 0), "OK").when(answered, "EMPTY").when(F.col("reachable"), "FAIL").otherwise("DEAD")
    return df.select("key", "name", "reachable", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status")).withColumn("failure", F.col("status").isin("EMPTY", "FAIL"))
