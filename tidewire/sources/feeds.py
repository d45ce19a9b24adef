"""RSS 2.0 and Atom bodies to headlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T

BODY_CHARS = 600
_RSS = "channel struct<item: array<struct<title: string, link: string, description: string, summary: string, guid: string, pubDate: string, date: string>>>, item: array<struct<title: string, link: string, description: string, summary: string, guid: string, pubDate: string, date: string>>"
_LINK = "array<struct<_VALUE: string, _href: string>>"
_ATOM = f"entry array<struct<title: string, link: {_LINK}, summary: string, content: string, id: string, updated: string, published: string>>"


def _first(*cols: Column) -> Column:
    """The first that is there and not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def parse_feeds(bodies: DataFrame, now: Column | None = None) -> DataFrame:
    """bodies (source, body as string or binary) to (source, id, headline, ts, body, symbols, url, pos).

    Items of RSS, else entries of Atom; those without a title are left out, those without a date count as of now. Bodies that
    aren't XML give nothing. pos is the place in its feed; a feed's rows ascend by (ts, pos).
    """
    now = F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now
    xml = F.regexp_replace(F.col("body").cast("string"), "(</?)(?:dc|atom|content|rdf):", "$1")
    options = {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreNamespace": "true"}
    rss, atom = (T_.StructType.fromDDL(x) for x in (_RSS, _ATOM))
    both = bodies.select("source", F.from_xml(xml, rss, options).alias("rss"), F.from_xml(xml, atom, options).alias("atom"))
    entry = "struct<title:string,link:string,body:string,guid:string,date:string>"

    def of_rss(x: Column) -> Column:
        return F.struct(x["title"].alias("title"), x["link"].alias("link"), _first(x["description"], x["summary"]).alias("body"), x["guid"].alias("guid"), _first(x["pubDate"], x["date"]).alias("date"))

    def of_atom(x: Column) -> Column:
        link = F.get(x["link"], F.lit(0))
        return F.struct(x["title"].alias("title"), _first(link["_VALUE"], link["_href"]).alias("link"), _first(x["summary"], x["content"]).alias("body"), x["id"].alias("guid"), _first(x["updated"], x["published"]).alias("date"))

    items = F.transform(F.coalesce(F.col("rss.channel.item"), F.col("rss.item")), of_rss)
    entries = F.transform(F.col("atom.entry"), of_atom)
    none = F.expr(f"cast(array() as array<{entry}>)")
    each = both.select("source", F.posexplode(F.when(F.size(F.coalesce(items, none)) > 0, items).otherwise(F.coalesce(entries, none))).alias("pos", "x"))
    c = {k: T.clean_markup(F.col(f"x.{k}")) for k in ("title", "link", "body", "guid")}
    out = each.select("source", "pos", *[v.alias(k) for k, v in c.items()], T.parse_date(F.col("x.date")).alias("date")).where("title != ''")
    return out.select(
        "source", T.stable_id(F.col("source"), F.col("guid"), F.col("title"), F.col("link")).alias("id"), F.col("title").alias("headline"),
        F.coalesce("date", now).alias("ts"), F.substring("body", 1, BODY_CHARS).alias("body"), F.expr("cast(array() as array<string>)").alias("symbols"), F.col("link").alias("url"), "pos",
    )


def unseen(items: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("source", "id")) -> DataFrame:
    """The first row of every id of a source that wasn't seen before."""
    return items.dropDuplicates(list(keys)).join(seen.select(*keys), list(keys), "left_anti")


def example_items(df: DataFrame, now: float) -> DataFrame:
    """Rows of the example format (id, source, headline, offset_min, symbols) as items around a time."""
    return df.select("id", "headline", "source", (F.lit(now) + 60.0 * F.col("offset_min")).alias("ts"), F.lit("").alias("body"), F.coalesce("symbols", F.expr("cast(array() as array<string>)")).alias("symbols"), F.lit("").alias("url"))
