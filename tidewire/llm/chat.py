"""Reply trees: root-to-leaf paths by iterative self-joins, ranked by score, each chosen path formatted as one conversation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, laid_out, materialize

#: The template's control strings.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Free a text of control strings, reversibly: a backslash becomes \\b and then <| becomes <\\p."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_reply_trees(spark: SparkSession, messages: DataFrame, top: int = 1) -> DataFrame:
    """Format the `top` best root-to-leaf paths of every tree.

    messages: tree (string), node, parent (long; null or unknown: a root), role, text (string), score (double).
    Returns tree, leaf, branch (1: best), path_score (mean score of the path), n_turns, formatted, loss_mask (an array
    of start and end in formatted, in characters: the texts of LOSS_ROLE).

    Each round joins the table of jumps with itself, so that after k rounds every node knows its ancestor 2^k up and the
    scores in between: log2(depth) rounds, each over one row per node that hasn't reached its root, keyed by node, so no tree is gathered. Leaves
    are ranked by path score (ties: smaller leaf). Chosen paths are laid out by the same jumps, and only then are texts
    joined and each path's turns gathered, as its one row must hold them.

    Null tree: the tree "". Null role or text: empty; null score: 0. A node number that repeats in a tree: its rows all
    take part, ordered by role and text, as one message of several turns. A cycle has no root, so no path. An empty
    table: no rows. Other columns are ignored.
    """
    m = messages.select(
        F.coalesce("tree", F.lit("")).alias("tree"), F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
    nodes = m.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.sum("score").alias("score"), F.count("*").alias("turns"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(1).alias("there"))
    nodes = nodes.join(known, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("there") == 1, F.col("parent")))
    jump = materialize(spark, nodes.select("tree", "node", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("hops")), "jump")
    jumps = [jump]
    most = math.ceil(math.log2(jump.count() + 1))  # rounds that reach the root of the longest path
    while len(jumps) <= most and not jump.where("up is not null").isEmpty():  # what is left then is cycles
        far = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("hops").alias("hops2"))
        further = jump.where("up is not null").join(far, ["tree", "up"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("hops") + F.col("hops2")).alias("hops")
        )
        jump = materialize(spark, jump.where("up is null").unionByName(further), "jump")
        jumps.append(jump)

    inner = jumps[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = jump.where("up is null").join(inner, ["tree", "node"], "left_anti").withColumn("path_score", F.col("total") / F.col("hops"))
    best = Window.partitionBy("tree").orderBy(F.desc("path_score"), "node")
    leaves = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= top)
    path = leaves.select("tree", F.col("node").alias("leaf"), "branch", "path_score", "hops", "node", F.lit(0).cast("long").alias("above"))
    for k in range(len(jumps) - 2, -1, -1):
        step = jumps[k].where("up is not null").select("tree", "node", "up")
        more = path.join(step, ["tree", "node"]).select("tree", "leaf", "branch", "path_score", "hops", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        path = materialize(spark, path.unionByName(more), "path")

    turns = path.join(m.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "branch", "path_score",
        F.struct((F.col("hops") - F.col("above")).alias("at"), F.col("role"), F.col("text"),
                 F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")).alias("turn"),
    )
    grouped = turns.groupBy("tree", "leaf", "branch").agg(F.first("path_score").alias("path_score"), F.array_sort(F.collect_list("turn")).alias("turns"))
    tail = CLOSE + "\n"
    width = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(tail)

    def place(t, at):
        begin = at + F.char_length(t["head"])
        return F.struct(begin.alias("start"), (begin + F.char_length(t["body"])).alias("end"), (t["role"] == LOSS_ROLE).alias("loss"))

    mask = F.filter(laid_out(F.col("turns"), width, place, "struct<start:int,end:int,loss:boolean>"), lambda x: x["loss"])
    return grouped.select(
        "tree", "leaf", "branch", "path_score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.transform(mask, lambda x: F.struct(x["start"], x["end"])).alias("loss_mask"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text."""
    parts = F.split(formatted, "<\\|im_end\\|>\n", -1)
    parts = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.split(p, "\n", 2))
    return F.transform(parts, lambda p: F.struct(unescape_role(F.substring(p[0], len(OPEN) + 1, 1 << 30)).alias("role"), unescape(p[1]).alias("text")))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the mask, unescaped, with nothing between them. By blocks of spans, whose part of the conversation is
    cut out first, as every cut counts characters from the beginning."""

    def block(spans):
        begin, end = F.get(spans, F.lit(0))["start"], F.element_at(spans, -1)["end"]
        text = lambda part: F.array_join(F.transform(spans, lambda s: unescape(F.substr(part, s["start"] - begin + 1, s["end"] - s["start"]))), "")
        return F.get(F.transform(F.array(F.substr(formatted, begin + 1, end - begin)), text), F.lit(0))

    return F.array_join(F.transform(blocks(loss_mask), lambda spans: F.when(F.size(spans) > 0, block(spans)).otherwise("")), "")
