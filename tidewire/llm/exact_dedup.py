"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash of what survives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialize, scratch

PREFIX_CHARS = 256
"""Characters hashed at the second level."""
BLOCK = 10_000
"""Copies of one row that are made at a time, as an array."""


def exact_duplicates(
    spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, and text_sha256 if digest is asked for.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the largest doc_id
    stays. Level one counts byte lengths, level two counts hashes of the first PREFIX_CHARS characters within lengths
    that occur twice, level three hashes whole texts, only of rows whose length and prefix both recur. Counts are
    pre-aggregated, so a group of copies of any size passes as counts; texts are never shuffled unless the recurring
    keys outgrow a broadcast.

    Null doc_id: smaller than every other. Repeated rows (same doc_id, equal text): one of them may stay, the others
    go. Ties can't arise otherwise. Empty table: no rows. Other columns, whatever their names, are ignored.
    """
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = body.select("doc_id", "text", F.octet_length("text").alias("n"), F.xxhash64(ascii_lower(F.substring("text", 1, PREFIX_CHARS))).alias("p"))
    with scratch(spark) as keep:
        counted = materialize(spark, keyed.groupBy("n", "p").agg(F.count("*").alias("c")), "prefixes")
        lengths = counted.groupBy("n").agg(F.sum("c").alias("of_length")).where("of_length > 1").select("n")
        again = materialize(spark, counted.where("c > 1").join(lengths, "n", "left_semi").select("n", "p", F.lit(True).alias("again")), "again")
        again = broadcast_if_small(again, again.count(), 32)

        whole = F.sha2(ascii_lower(F.col("text")), 256)
        read = keyed.join(again, ["n", "p"], "left").select(
            "doc_id", "n", "p", F.when(F.col("again"), whole).alias("h"), *([whole.alias("text_sha256")] if digest else [])
        )
        rows = materialize(spark, read, "rows")
        more = ["text_sha256"] if digest else []
        alone = rows.where("h is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *more)

        members = materialize(spark, rows.where("h is not null").groupBy("n", "p", "h", "doc_id", *more).agg(F.count("*").alias("c")), "members")
        groups = materialize(spark, members.groupBy("n", "p", "h").agg(F.max("doc_id").alias("keep_id"), F.sum("c").alias("group_size")), "groups")
        keep(rows, members, groups)
    grouped = (
        members.join(groups, ["n", "p", "h"])
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("c") - 1).cast("long"), F.lit(BLOCK).cast("long"))))
        .withColumn("copy", F.explode(F.sequence(F.col("block") + 1, F.least(F.col("block") + BLOCK, F.col("c")))))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), *more)
    )
    return alone.unionByName(grouped)
