"""The corpus pipeline: language identification, exact and near duplicates, decontamination, packing.

All stages: null text counts as empty, texts are read whole, an empty table gives no rows, other columns whatever their names
are kept as they are (packing returns its own instead). What a stage does with null or repeated ids and ties, it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import common, decontam, exact_dedup, langid, packing, queries, similar

ORACLE_SQL = None
"""SQL can't express the text model, the near-duplicate groups or the packing; tests/llm compares
the operators that the stages call with brute force, the language model apart."""


def _row():
    """A hash that, beside the doc_id, tells rows apart unless they have equal ids and texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _without(spark: SparkSession, docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that `gone` (doc_id, row) names; texts move only if it is too large to broadcast."""
    i, r = common.fresh(docs, "gone_id"), common.fresh(docs, "gone_row")
    gone = common.materialize(spark, gone.select(F.col("doc_id").alias(i), F.col("row").alias(r)), "gone")
    gone = common.broadcast_if_small(gone, gone.count(), 32)
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (_row() == F.col(r)), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identifiable language. The source stands for the host, the lang column for declared markup.
    Empty texts and those without letters go. Rows alike in id and text share their fate; rows that share an id alone don't."""
    model = langid.fit_text_model(docs)
    rows = docs.select("doc_id", _row().alias("row"), "text", F.col("source").alias("host"), F.col("lang").alias("declared"))
    found = langid.identify(spark, rows, model, ["doc_id", "row"])
    return _without(spark, docs, found.where("rejected").select("doc_id", "row").distinct())


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for A-Z's case, the row of the largest doc_id, a null id before all others; of repeated rows
    one."""
    found = common.materialize(spark, exact_dedup.exact_duplicates(spark, docs), "exact")
    gone = found.where(~F.col("kept"))
    if gone.isEmpty():
        return docs
    i = common.fresh(docs, "gone_id")
    if found.count() == found.agg(F.countDistinct("doc_id")).first()[0]:
        gone = gone.select(F.col("doc_id").alias(i))
        return docs.join(common.broadcast_if_small(gone, gone.count(), 16), F.col("doc_id") == F.col(i), "left_anti")
    # Ids repeat or are null: of equal texts those of the largest id stay, and of these rows one.
    t, u = common.fresh(docs, "own_text"), common.fresh(docs, "kept_text")
    named = docs.withColumn(t, F.sha2(common.ascii_lower(F.col("text")), 256))
    top = named.groupBy(F.col(t).alias(u)).agg(F.max("doc_id").alias(i))
    return named.join(top, (F.col(t) == F.col(u)) & F.col("doc_id").eqNullSafe(F.col(i))).drop(u, i).dropDuplicates([t]).drop(t)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row of the smallest doc_id, a
    null id after all others. Rows alike in id and text are one document and all stay or go. Texts without words are in no group."""
    n, alone = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    node = F.col("doc_id").cast("long") if n == alone else F.xxhash64("doc_id", "text")
    rows = docs.select(node.alias("node"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("id"))
    if n != alone:  # rows alike in id and text are one node
        rows = rows.dropDuplicates(["node"])
    groups = similar.similar_groups(spark, rows.select("node", "text"))
    if n != alone:
        groups = common.materialize(spark, groups.join(rows.select("node", "id"), "node"), "groups")
        first = groups.groupBy("root").agg(F.min_by("node", F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
        groups = groups.join(first, "root").select("node", F.col("first").alias("root"))
    i = common.fresh(docs, "gone_id")
    gone = common.materialize(spark, groups.where("node != root").select(F.col("node").alias(i)), "gone")
    return docs.join(common.broadcast_if_small(gone, gone.count(), 16), node == F.col(i), "left_anti")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Repeated rows and null ids: each row is judged by its own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(spark, docs, benchmark, clean=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left. Repeated rows and null ids: each row is packed; an empty text as its end alone."""
    return packing.pack(spark, docs, queries.TOKENIZER)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(spark, stage(spark, docs, sf_dir), name)
    return docs
