"""Economic releases: finding them in headlines, their surprise, priority and line, as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import fixed

_BY_LENGTH = sorted(rules.INDICATORS, key=len, reverse=True)


def indicator(text: Column) -> Column:
    """The longest indicator that stands in the text as words of their own, else empty."""
    low, out = F.lower(text), None
    for name in _BY_LENGTH:
        here = F.contains(low, F.lit(name)) & low.rlike(f"(?U)(?<!\\w){re.escape(name)}(?!\\w)")
        out = F.when(here, name) if out is None else out.when(here, name)
    return out.otherwise("")


def params(name: Column) -> Column:
    """struct(sigma, weight) of an indicator: its own, else that of the first listed one within its name, else the default."""
    key, out = F.lower(F.trim(name)), None
    pair = lambda v: F.struct(F.lit(v[0]).alias("sigma"), F.lit(v[1]).alias("weight"))
    for exact in (True, False):
        for k, v in rules.INDICATORS.items():
            here = key == k if exact else F.contains(key, F.lit(k))
            out = F.when(here, pair(v)) if out is None else out.when(here, pair(v))
    return out.otherwise(pair(rules.DEFAULT_INDICATOR))


def _number(text: Column, pattern: str) -> Column:
    found = F.nullif(F.regexp_extract(text, "(?iU)" + pattern, 1), F.lit(""))
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def parse(headline: Column, name: Column) -> Column:
    """struct(indicator, period, actual, expected, prior, unit); null unless an actual value is there. Signs come from the
    number alone, not from verbs, and a comma is a decimal mark."""
    actual = _number(headline, rules.ACTUAL)
    unit = F.upper(F.nullif(F.regexp_extract(headline, "(?iU)" + rules.ACTUAL, 2), F.lit("")))
    period = F.upper(F.regexp_extract(headline, "(?iU)" + rules.PERIOD, 1))
    for was, to in (("MOM", "M/M"), ("YOY", "Y/Y"), ("QOQ", "Q/Q")):
        period = F.replace(period, F.lit(was), F.lit(to))
    whole = F.struct(
        name.alias("indicator"), period.alias("period"), actual.alias("actual"),
        F.when(headline.rlike("(?iU)" + rules.EXPECTED), _number(headline, rules.EXPECTED)).otherwise(_number(headline, rules.EXPECTED_AFTER)).alias("expected"),
        _number(headline, rules.PRIOR).alias("prior"), F.coalesce(unit, F.lit("%")).alias("unit"),
    )
    return F.when(actual.isNotNull(), whole)


def surprise(actual: Column, expected: Column) -> Column:
    """Signed miss against the consensus; null without one."""
    return actual - expected


def surprise_sigma(name: Column, actual: Column, expected: Column) -> Column:
    """Size of the miss in the indicator's usual surprises; 0 without a consensus."""
    return F.coalesce(F.abs(surprise(actual, expected)) / params(name)["sigma"], F.lit(0.0))


def priority(name: Column, actual: Column, expected: Column) -> Column:
    weight = params(name)["weight"]
    strength = surprise_sigma(name, actual, expected) * weight
    return F.when(strength >= 1.8, rules.CRITICAL).when(strength >= 0.8, rules.IMPORTANT).when(weight >= 0.8, rules.NORMAL).otherwise(rules.LOW)


def shown(value: Column, unit: Column) -> Column:
    text = F.when(F.abs(value) < 100, fixed(value, 1)).otherwise(fixed(value, 0))
    text = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, "\\.?0+$", "")).otherwise(text)
    return F.coalesce(F.concat(text, unit), F.lit("N/A"))


def body(release: Column) -> Column:
    """INDICATOR PERIOD actual VS. EXP. expected (PREV. prior), with the parts that are there."""
    unit, expected, prior = release["unit"], release["expected"], release["prior"]
    return F.concat_ws(
        " ", F.upper(release["indicator"]), F.nullif(F.upper(release["period"]), F.lit("")), shown(release["actual"], unit),
        F.when(expected.isNotNull(), F.concat(F.lit("VS. EXP. "), shown(expected, unit))),
        F.when(prior.isNotNull(), F.concat(F.lit("(PREV. "), shown(prior, unit), F.lit(")"))),
    )
