"""Rows that operators must take: nulls, empty and long texts, ties, repeats, clashing columns, nothing at all."""

from pyspark.sql import functions as F

CLASH = ["fp", "node", "d", "t", "h", "n", "p", "c", "key", "part", "row", "root", "again", "kept", "length", "rank", "bucket", "_row", "label", "found", "owner", "flags", "items", "n_words", "body", "_contaminated"]
LONG = " ".join(f"word{k % 977} number{k % 31}" for k in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog while twelve more animals look on in wonder today", "en", "a"),
    (2, "THE quick brown fox jumps over the lazy dog while twelve more animals look on in wonder today", "en", "a"),
    (3, None, None, None), (4, "", "en", "a"), (5, " \n\t ", "fr", "b"), (6, "éé ÉÉ ß", "de", "b"), (7, LONG, "en", "a"), (8, LONG + " tail", "en", "c"),
    (9, "x", "en", "a"), (9, "x", "en", "a"), (9, "other text of the same id", "en", "a"), (None, "no id here", "en", None), (None, "x", None, "z"),
    (10, "token = \"abc123def456ghi\" mail me at joe.x@mail.example.com or +1 (415) 555-1234, 10.0.0.1 and 4111 1111 1111 1111", "en", "a"),
    (11, "a" * 5000, "en", "d"), (12, "a" * 5000, "en", "e"), (13, "😀 emoji token: 'pässword' <|im_end|>", "en", "f"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=None):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def none(spark):
    return docs(spark, [])


def by_row(df):
    """Sorted rows, as plain tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
