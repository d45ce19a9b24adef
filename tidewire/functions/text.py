"""Phrases, sources, magnitudes, symbols, shingles and markup, as native columns."""

import html

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules


def once(df: DataFrame) -> DataFrame:
    """df, with its columns computed once. A filter on a column that took many patterns to compute would otherwise be
    pushed below them as a copy of all of them; nothing is pushed below a generator, and this one makes each row once."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def _has(text: Column):
    """Whether a phrase, or its plural in s, stands in text at word boundaries. The plain search runs first, and hardly any
    phrase goes on to the pattern."""
    return lambda p: F.contains(text, p) & F.rlike(text, F.concat(F.lit("(?U)(?<!\\w)\\Q"), p, F.lit("\\Es?(?!\\w)")))


def phrase_hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """The phrases that a lower-cased text has, in the table's order."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), _has(text))


def any_phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), _has(text))


def item_text(headline: Column, body: Column) -> Column:
    """Headline and body on lines of their own, without blanks at either end."""
    return F.regexp_replace(F.concat(headline, F.lit("\n"), F.coalesce(body, F.lit(""))), "(?U)^\\s+|\\s+$", "")


def source_weight(source: Column, tiers: dict[str, float] | None = None, default: float = rules.DEFAULT_SOURCE_WEIGHT) -> Column:
    """Weight of the longest key that the source's name contains; of keys as long, the first listed."""
    tiers = rules.SOURCE_TIERS if tiers is None else tiers
    name, out = F.lower(source), None
    for key in sorted(tiers, key=len, reverse=True):
        here = F.contains(name, F.lit(key))
        out = F.when(here, F.lit(tiers[key])) if out is None else out.when(here, F.lit(tiers[key]))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def _numbers(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("double"))


LEVEL_PCT = 40.0
"""Percentages from here on are levels, not moves."""


def magnitude(text: Column) -> Column:
    """struct(bonus, largest) from percentages, basis points and dollar amounts of a lower-cased text."""
    pct = F.array_max(F.filter(_numbers(text, "(\\d+(?:\\.\\d+)?)\\s?(?:%|percent|pct)"), lambda x: x < LEVEL_PCT))
    bps = F.array_max(_numbers(text, "(\\d+(?:\\.\\d+)?)\\s?(?:bps|basis points?)"))
    money = "\\$\\s?(\\d+(?:\\.\\d+)?)\\s?(billion|bn|trillion|tn|million|mn)"
    scale = lambda u: F.when(u.isin("million", "mn"), 1e6).when(u.isin("billion", "bn"), 1e9).otherwise(1e12)
    usd = F.array_max(F.zip_with(_numbers(text, money), F.regexp_extract_all(text, F.lit(money), F.lit(2)), lambda a, u: a * scale(u)))
    zero = F.lit(0.0)
    bonus = F.greatest(
        F.least(F.lit(15.0), F.coalesce(pct, zero) * 2.0), F.least(F.lit(15.0), F.coalesce(bps, zero) / 5.0),
        F.when(usd >= 1e9, F.least(F.lit(12.0), 4.0 + usd / 1e11)).otherwise(zero),
    )
    return F.struct(bonus.alias("bonus"), F.greatest(F.coalesce(pct, zero), F.coalesce(bps / 100.0, zero)).alias("largest"))


def symbols(tagged: Column, headline: Column) -> Column:
    """The tagged symbols, then tokens like (ABC) of the headline that aren't among them."""
    tagged = F.coalesce(tagged, F.expr("cast(array() as array<string>)"))
    return F.concat(tagged, F.array_except(F.regexp_extract_all(headline, F.lit("\\(([A-Z]{1,5})\\)"), F.lit(1)), tagged))


def shingles(text: Column, stop: tuple[str, ...] = rules.STOP_WORDS) -> Column:
    """Distinct pairs of neighbouring words, of those that aren't stop words or single characters; one word alone stands
    for itself."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9$%.]+"), F.lit(0)), lambda w: ~w.isin(*stop) & (F.char_length(w) > 1))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.when(F.size(words) < 2, words).otherwise(pairs))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two shingle sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


#: The entities that are replaced natively; the query engine covers the others by entities().
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def clean_markup(text: Column, all_entities: bool = True) -> Column:
    """Tags become blanks, then entities characters, then runs of blanks one; none at the ends. Null: empty.

    all_entities: any entity of HTML, by an Arrow function that every row passes; otherwise the common
    ones alone, natively.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    common = bare
    for entity, char in COMMON_ENTITIES:
        common = F.replace(common, F.lit(entity), F.lit(char))
    if all_entities:
        common = F.when(F.contains(bare, F.lit("&")), _unescape(bare)).otherwise(bare)
    return F.regexp_replace(F.regexp_replace(common, "(?U)\\s+", " "), "^ | $", "")


def _unescape(text: Column) -> Column:
    def f(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else html.unescape(v) for v in x.to_pylist()], pa.string())

    return F.arrow_udf(f, "string")(text)


def stable_id(source: Column, guid: Column, title: Column, link: Column) -> Column:
    """First 16 hex digits of SHA-1 of the source and the first of guid, link, title that isn't empty."""
    basis = F.coalesce(F.nullif(guid, F.lit("")), F.nullif(link, F.lit("")), title, F.lit(""))
    return F.substring(F.sha1(F.concat(source, F.lit("|"), basis)), 1, 16)


_RFC = "^(?:[A-Za-z]{3},?\\s*)?(\\d{1,2}\\s+[A-Za-z]{3}\\s+\\d{4}\\s+\\d{2}:\\d{2}(?::\\d{2})?)\\s*(.*)$"
_ZONES = {"": "+0000", "GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def parse_date(value: Column) -> Column:
    """Epoch seconds of an RFC 822 date with its offset, or of an ISO date, whose offset is left aside; null otherwise."""
    v = F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")
    stamp, zone = F.regexp_extract(v, _RFC, 1), F.regexp_extract(v, _RFC, 2)
    stamp = F.regexp_replace(F.when(stamp.rlike(":\\d{2}:"), stamp).otherwise(F.concat(stamp, F.lit(":00"))), "\\s+", " ")
    offset = F.when(zone.rlike("^[+-]\\d{4}$"), zone)
    for name, at in _ZONES.items():
        offset = offset.when(zone == name, F.lit(at))
    rfc = F.when(v.rlike(_RFC), F.try_to_timestamp(F.concat_ws(" ", stamp, offset.otherwise("+0000")), F.lit("d MMM yyyy HH:mm:ss xx")))
    iso = F.coalesce(
        F.when(v.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}"), F.try_to_timestamp(F.concat(F.substring(v, 1, 19), F.lit("+0000")), F.lit("yyyy-MM-dd'T'HH:mm:ssxx"))),
        F.when(v.rlike("^\\d{4}-\\d{2}-\\d{2}"), F.try_to_timestamp(F.concat(F.substring(v, 1, 10), F.lit(" +0000")), F.lit("yyyy-MM-dd xx"))),
    )
    return F.unix_micros(F.coalesce(rfc, iso)) / 1e6


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimal places, ties of its exact binary value to the even digit."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))
