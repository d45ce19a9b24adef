"""Language identification by Bayesian fusion of text, markup, address suffix and host priors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_if_small, chunks, materialize, utf8

SAMPLE_ROWS = 2000
"""Labelled rows that the text model is fitted on at most, those of each language's smallest hashes."""
SAMPLE_CHARS = 20_000
"""Of longer labelled rows a part of so many is fitted on."""
BUCKETS_BITS = 16
SMOOTH = 0.5
STRENGTH = 8.0
"""Rows that a parent's prior counts for in its child's."""
INDEPENDENT = 100
"""Trigrams of a text count as so many independent ones at most, as neighbours share letters and topics."""
CHUNK = 1 << 19

#: Letters in lower case (bytes above ASCII stand for themselves), and a blank for anything else.
_MAP = np.full(256, 32, np.uint8)
_MAP[128:] = np.arange(128, 256)
for _a, _b in zip(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", strict=True):
    _MAP[[_a, _b]] = _b


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram around a letter, and the number of the text it is in. Texts begin and end with a blank."""
    n = len(off) - 1
    x = np.full(len(data) + n + 1, 32, np.uint8)
    x[np.arange(len(data)) + np.repeat(np.arange(n) + 1, np.diff(off))] = _MAP[data]
    v = (x[:-2].astype(np.uint32) << 16) | (x[1:-1].astype(np.uint32) << 8) | x[2:]
    at = np.flatnonzero(x[1:-1] != 32)
    bucket = (v[at] * np.uint32(2654435769)) >> np.uint32(32 - BUCKETS_BITS)
    return bucket.astype(np.int64), np.searchsorted(off[:-1] + np.arange(n), at, "right") - 1


@dataclass
class TextModel:
    """Log probabilities of trigram buckets, a column for each language."""

    languages: list[str]
    table: np.ndarray

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> TextModel:
        languages = sorted({lang for lang, _ in rows})
        counts = np.full((1 << BUCKETS_BITS, max(1, len(languages))), SMOOTH)
        for k, lang in enumerate(languages):
            data = "\n".join(t for x, t in rows if x == lang).encode()
            bucket, _ = _trigrams(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            np.add.at(counts[:, k], bucket, 1)
        return cls(languages or ["und"], np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rows to take of each language: as even as their counts allow, one at least."""
    out = {}
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = max(1, min(counts[lang], total // (len(counts) - k)))
        total -= out[lang]
    return out


def fit_text_model(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> TextModel:
    """Fit on labelled rows chosen by hash over all rows, as evenly of each language as there are rows: SAMPLE_ROWS at most,
    or one of each language if there are more of these. Of a row of over SAMPLE_CHARS characters, one part of so many."""
    rows = labelled.select(F.lower(F.col(lang)).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"))
    rows = rows.where("lang is not null and lang != '' and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()  # as many rows as languages
    share = _shares({r.lang: r.n for r in found}, SAMPLE_ROWS)
    # Hashes are even, so those below a language's share of their range are about so many; six deviations more, to have them all.
    last = {r.lang: min((1 << 63) - 1, max(r.least, int((share[r.lang] + 6 * share[r.lang] ** 0.5 + 6) / r.n * (1 << 64)) - (1 << 63))) for r in found}
    bounds = broadcast_if_small(labelled.sparkSession.createDataFrame(list(last.items()), "lang string, last long"), len(last), 32)
    part = F.pmod("h", F.greatest(F.ceil(F.char_length("text") / SAMPLE_CHARS), F.lit(1))) * SAMPLE_CHARS + 1
    chosen = rows.join(bounds, "lang").where(F.col("h") <= F.col("last")).select("lang", "h", F.substring(F.col("text"), part.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    by: dict[str, list] = {}
    for r in sorted(chosen.dropDuplicates(["lang", "h"]).collect()):
        by.setdefault(r.lang, []).append(r.text)
    return TextModel.fit(sorted((x, t) for x, texts in by.items() for t in texts[: share[x]]))


class _Likelihoods:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = self.model.value.table
        for b in batches:
            data, off = utf8(b.column("text"))
            sums, grams = np.zeros((b.num_rows, table.shape[1])), np.zeros(b.num_rows, np.int64)
            for i, j in chunks(off, CHUNK):
                bucket, row = _trigrams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                grams[i:j] = np.bincount(row, minlength=j - i)
                for k in range(table.shape[1]):
                    sums[i:j, k] = np.bincount(row, weights=table[:, k][bucket], minlength=j - i)
            ll = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), table.shape[1]).cast(pa.list_(pa.float64()))
            keep = [b.column(n) for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*keep, ll, pa.array(grams)], names=[*(n for n in b.schema.names if n != "text"), "ll", "grams"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def declared_in(html: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z]{2,3})", 1))


def text_of(html: Column) -> Column:
    """What a reader sees, roughly: markup, scripts, styles, comments and character references become blanks."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style)\\b.*?</\\1\\s*>|<!--.*?-->|<[^>]*>|&#?[a-z0-9]{1,32};", " ")


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def identify(spark: SparkSession, rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """rows: keys, text, host, declared (a language code or empty). Returns keys, lang, confidence, text_lang, declared,
    host, grams, rejected.

    The text's likelihood counts as INDEPENDENT trigrams at most. How far a declared language is to be believed comes from
    counting declared against likely languages over all rows; an unknown or missing one says nothing. The prior is that of
    the host, smoothed by its domain's, that by its suffix's, that by the whole table's, from sums of text posteriors by
    host, pre-aggregated, and then of those sums; a row's own share is left out of all of them. Rows join their host's sums
    on a key that may be hot, on narrow rows, which Spark splits.

    rejected: the text has no letters, or no language makes its trigrams likelier than equal chances would. Null or
    empty text is rejected, its language the prior's. Null host or declared: empty. Null keys, repeated rows: kept. No
    languages in the model: all are "und". Empty table: no rows. Other columns are ignored.
    """
    bound_batches(spark)
    langs, n = model.languages, len(model.languages)
    inner = [f"k{i}" for i in range(len(keys))]
    host = F.lower(F.coalesce(F.col("host").cast("string"), F.lit("")))
    label = F.split(host, "\\.")
    base = rows.select(
        *[F.col(f"`{k}`").alias(i) for k, i in zip(keys, inner, strict=True)], host.alias("host"),
        F.when(F.size(label) > 1, F.array_join(F.slice(label, -2, 2), ".")).otherwise(host).alias("domain"),
        F.when(F.size(label) > 1, F.element_at(label, -1)).otherwise("").alias("suffix"),
        F.lower(F.coalesce(F.col("declared").cast("string"), F.lit(""))).alias("declared"), F.col("text").cast("string").alias("text"),
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema if f.name != "text")
    scored = base.mapInArrow(_Likelihoods(spark.sparkContext.broadcast(model)), f"{kinds}, ll array<double>, grams long")
    shrink = F.least(F.lit(1.0), F.lit(float(INDEPENDENT)) / F.greatest(F.col("grams"), F.lit(1)))
    scored = scored.withColumn("log", F.transform("ll", lambda x: x * shrink))
    scored = materialize(spark, scored.withColumn("p", _softmax(F.col("log"))), "likelihoods")

    total = [F.sum(F.element_at("p", i + 1)).alias(f"s{i}") for i in range(n)]
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    array = lambda *c: F.array(*[F.col(f"s{i}") for i in range(n)])
    hosts = materialize(spark, scored.groupBy("host", "domain", "suffix").agg(*total), "hosts")
    domains = materialize(spark, hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    suffixes = materialize(spark, domains.groupBy("suffix").agg(*sums), "suffixes")
    whole = suffixes.agg(*sums).first()
    whole = [float(x or 0.0) for x in whole] if whole else [0.0] * n
    by = hosts.select("host", "domain", "suffix", array().alias("of_host"))
    by = by.join(domains.select("domain", "suffix", array().alias("of_domain")), ["domain", "suffix"])
    by = by.join(suffixes.select("suffix", array().alias("of_suffix")), "suffix")
    priors = materialize(spark, by.select("host", "of_host", "of_domain", "of_suffix"), "priors")

    said = scored.where(F.col("declared").isin(langs)).groupBy("declared").agg(*total).collect()  # at most n rows of n sums
    table = np.full((n, n), SMOOTH)
    for r in said:
        table[langs.index(r["declared"])] += [float(r[f"s{i}"]) for i in range(n)]
    table = np.log(table / table.sum(axis=0))  # of what is declared, given the language
    believed = F.lit(0)
    believed = F.array(*[F.lit(0.0)] * n)
    for k, lang in enumerate(langs):
        believed = F.when(F.col("declared") == lang, F.array(*[F.lit(float(x)) for x in table[k]])).otherwise(believed)

    def smoothed(sums: Column, parent: Column) -> Column:
        rest = F.zip_with(sums, "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        of = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, parent, lambda a, q: (a + STRENGTH * q) / (of + STRENGTH))

    flat = F.array(*[F.lit(1.0 / n)] * n)
    prior = flat
    for level in (F.array(*[F.lit(x) for x in whole]), F.col("of_suffix"), F.col("of_domain"), F.col("of_host")):
        prior = smoothed(level, prior)
    fused = scored.join(priors, "host").withColumn("prior", prior).withColumn("believed", believed)
    logs = F.zip_with(F.zip_with("log", "believed", lambda a, b: a + b), F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b)
    fused = fused.withColumn("post", _softmax(logs))
    names = F.array(*[F.lit(x) for x in langs])
    top = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    even = F.col("grams") * -math.log(1 << BUCKETS_BITS)
    return fused.select(
        *[F.col(i).alias(k) for k, i in zip(keys, inner, strict=True)], top(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"),
        F.when(F.col("grams") > 0, top(F.col("p"))).alias("text_lang"), "declared", "host", "grams",
        ((F.col("grams") == 0) | (F.array_max("ll") < even)).alias("rejected"),
    )
