"""Headline to tape line: attribution, region, compression and rendering, as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..storage import by_distinct
from .text import once

WIDTH = 108
_ANY_CASE = "(?iU)"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def region(text: Column, source: Column | None = None, default: Column | None = None) -> Column:
    """Region of the keyword that stands first in the text (of several at one place the first listed), else the source's,
    else the default."""
    low = F.lower(text)
    found = []
    for order, (name, word, whole) in enumerate(rules.REGION_KEYWORDS):
        pattern = f"(?U)(?<!\\w){re.escape(word)}" + ("(?!\\w)" if whole else "")
        at = F.when(F.contains(low, F.lit(word)), F.regexp_instr(low, F.lit(pattern)))
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(name).alias("region"))))
    out = F.array_min(F.array_compact(F.array(*found)))["region"]
    if source is not None:
        hint = None
        for key, name in rules.REGION_BY_SOURCE.items():
            here = F.contains(F.lower(source), F.lit(key))
            hint = F.when(here, name) if hint is None else hint.when(here, name)
        out = F.coalesce(out, hint)
    return F.coalesce(out, default if default is not None else F.lit(""))


def organisation(raw: Column) -> Column:
    """The canonical name of an institution: an alias that is all of it (or with 's), else one within it, else empty."""
    low, out = F.lower(F.trim(raw)), None
    for whole in (True, False):
        for pattern, name in rules.ORG_ALIASES:
            here = low.rlike(f"^(?:{pattern})$") | low.rlike(f"^(?:{pattern}'s)$") if whole else low.rlike(pattern)
            out = F.when(here, name) if out is None else out.when(here, name)
    return out.otherwise("")


_ORG = "|".join(f"(?:{p})" for p, _ in rules.ORG_ALIASES)
SPEAKER = (
    _ANY_CASE
    + rf"^(?:(?-i:[A-Z][\w.'-]+)\s+){{0,2}}({_ORG})(?:'s)?\s+(?:(?:{rules.TITLES})\s+)*(?!(?:{rules.NOT_A_NAME})(?!\w))"
    + r"((?-i:[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+)?))\s*"
    + rf"(?:(?:{rules.TELL_VERBS})\s+(?-i:[A-Z][\w.&'-]+)\s+(?:that\s+)?|(?:{rules.SAY_VERBS})\s+(?:that\s+)?|:\s*)(.+)$"
)


def with_speaker(df: DataFrame, headline: str) -> DataFrame:
    """df with org, speaker and rest of a headline; org and speaker empty and rest the headline unless a known
    institution's named speaker says three words or more."""
    part = lambda k: F.regexp_extract(headline, SPEAKER, k)
    df = once(df.withColumns({"_org": part(1), "_who": trim(part(2)), "_said": trim(part(3))}))
    df = once(df.withColumn("_org", F.when(F.col("_org") != "", organisation(F.col("_org"))).otherwise("")))
    good = (F.col("_org") != "") & (F.size(F.split("_said", "(?U)\\s+")) >= 3)
    df = df.withColumns(
        {"org": F.when(good, F.col("_org")).otherwise(""), "speaker": F.when(good, F.upper("_who")).otherwise(""), "rest": F.when(good, F.col("_said")).otherwise(F.col(headline))}
    )
    return df.drop("_org", "_who", "_said")


def strip_cruft(headline: Column) -> Column:
    """Without a publisher at the end and a label such as BREAKING: in front."""
    return trim(F.regexp_replace(F.regexp_replace(headline, _ANY_CASE + rules.TRAILER, ""), _ANY_CASE + rules.LEADER, ""))


def compress(text: Column) -> Column:
    """Dollar amounts as USD, then the table's shortenings in order, then single blanks."""
    amount = _ANY_CASE + "\\$\\s?(\\d[\\d,.]*)\\s*"
    for unit, short in rules.MONEY_UNITS:
        text = F.regexp_replace(text, amount + unit, f"USD $1{short}")
    text = F.regexp_replace(text, amount, "USD $1")
    for pattern, short in rules.COMPRESSIONS:
        text = F.regexp_replace(text, _ANY_CASE + pattern, short)
    return trim(F.regexp_replace(F.regexp_replace(text, "(?U)\\s+", " "), "(?U)(\\d)\\s+%", "$1%"))


def with_tape_line(df: DataFrame, default_region: Column | None = None, width: int = WIDTH) -> DataFrame:
    """df (headline, source, symbols, ...) with body, region, org and speaker. In steps, each computed once; once a headline,
    source, default and symbols where these repeat much."""
    df = df.withColumns({"_default": default_region if default_region is not None else F.lit(""), "_lead": F.array_join(F.slice("symbols", 1, 3), "/"), "_led": F.size("symbols") > 0})
    return by_distinct(df, ["headline", "source", "_default", "_lead", "_led"], lambda x: _tape_line(x, width)).drop("_default", "_lead", "_led")


def _tape_line(df: DataFrame, width: int) -> DataFrame:
    df = once(df.withColumn("_clean", strip_cruft(F.col("headline"))))
    df = with_speaker(df, "_clean")
    by_org = F.element_at(F.create_map(*[F.lit(x) for kv in rules.REGION_BY_ORG.items() for x in kv]), F.col("org"))
    df = once(df.withColumns({"region": F.coalesce(by_org, region(F.col("_clean"), F.col("source"), F.col("_default"))), "_plain": F.upper(compress(F.col("rest")))}))
    # What the tag says needn't lead the body too.
    lead = F.concat(F.lit("(?U)^"), F.col("region"), F.lit("(?=[\\s,:-]|$)[\\s,:-]*"))
    bare = F.when(F.col("region") != "", F.regexp_replace("_plain", lead, F.lit(""))).otherwise(F.col("_plain"))
    said = F.concat(F.col("org"), F.lit("'S "), F.col("speaker"), F.lit(": "), F.col("_plain"))
    df = once(df.withColumn("_bare", F.when(F.col("org") != "", said).otherwise(bare)))
    led = F.col("_led") & (F.col("org") == "") & ~F.startswith("_bare", "_lead")
    df = once(df.withColumn("_body", F.when(led, F.concat(F.col("_lead"), F.lit(": "), F.col("_bare"))).otherwise(F.col("_bare"))))
    cut = F.concat(F.regexp_replace(F.substring("_body", 1, width), " [^ ]*$", ""), F.lit("..."))
    return once(df.withColumn("body", F.when(F.char_length("_body") > width, cut).otherwise(F.col("_body"))).drop("_clean", "rest", "_plain", "_bare", "_body"))


def marker(priority: Column) -> Column:
    return F.when(priority >= rules.CRITICAL, "*").otherwise("-")


def render(body: Column, region: Column, priority: Column, ts: Column | None = None) -> Column:
    """[HH:MM:SS ]marker[(REGION) ]body, with the time of day in UTC if a time in epoch seconds is given."""
    tag = F.when(region != "", F.concat(F.lit("("), region, F.lit(") "))).otherwise("")
    line = F.concat(marker(priority), tag, body)
    if ts is None:
        return line
    second = F.pmod(F.floor(ts).cast("long"), F.lit(86400))
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    return F.concat(F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60)), F.lit(" "), line)


def spoken(body: Column, region: Column) -> Column:
    """The line for a voice: abbreviations spelt out, sentence case."""
    for short, word in rules.SPOKEN:
        body = F.replace(body, F.lit(short), F.lit(word))
    text = F.concat(F.upper(F.substring(body, 1, 1)), F.lower(F.substring(body, 2, 1 << 30)))
    return F.replace(F.concat(F.when(region != "", F.concat(region, F.lit(". "))).otherwise(""), text), F.lit("  "), F.lit(" "))
