"""Secrets judged by ownership: how many owners and repositories share a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import laid_out, materialize

#: The patterns of each kind, in the order of the output, with the group that holds the secret and the
#: least length of it. Runs of access and hex are maximal, so their least lengths stand in the patterns.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
VENDOR = (
    "(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|"
    "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,})"
)
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("vendor", VENDOR, 0, 1))
BASE = 3
"""The first kinds: what they find always stays. A vendor token is added only if it looks live."""

SHARED_OWNERS = 3
"""A candidate that this many owners have is a copied example."""
SHARED_REPOSITORIES = 5
"""So is one that this many repositories have, of however few owners."""
LIVE_CHARS = 12
"""A live-looking secret has this many characters at least, letters and digits among them."""

_SPAN = "struct<start:int,end:int,k:int,secret:string>"
_FOUND = f"array<{_SPAN}>"


def _find(text: Column, k: int) -> Column:
    """Matches of a kind, leftmost and not overlapping: start and end in characters, kind number, the secret.

    split() gives what lies between the matches and regexp_extract_all() the matches, so their lengths give the places.
    """
    _, pattern, group, least = KINDS[k]
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(hits, between, lambda hit, gap: F.struct(gap.alias("gap"), hit.alias("hit")))
    width = lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"])

    def span(x, at):
        secret = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        return F.struct((at + F.char_length(x["gap"])).alias("start"), (at + width(x)).alias("end"), F.lit(k).alias("k"), secret.alias("secret"))

    found = laid_out(F.filter(zipped, lambda x: x["hit"].isNotNull()), width, span, _SPAN)
    found = F.filter(found, lambda x: F.char_length(x["secret"]) >= least)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.expr(f"cast(array() as {_FOUND})"))


def _shown(found: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(name) for name, *_ in KINDS])
    by = F.transform(found, lambda x: F.struct(x["start"], x["k"], x["end"]))
    return F.array_join(F.transform(F.array_sort(by), lambda x: F.concat_ws(":", names[x["k"]], x["start"], x["end"])), ",")


def scan_secrets(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base (spans of those kinds), spans (with what the
    method adds), n_live, n_example, n_weak (verdicts on all candidates), and live (the secrets' SHA-256s).

    A candidate's hash is counted by distinct repositories within owners and then by owners, each time pre-aggregated,
    so an example copied everywhere passes as one row for each owner. It is an example from shared_owners owners or
    shared_repositories repositories on; else it looks live if it has LIVE_CHARS characters with letters and digits, and is weak
    otherwise. Candidates join their
    verdict by hash, on narrow rows without texts, and meet again by row.

    Null text: empty. Null owner or repository: one owner or repository of that name. Null doc_id and repeated rows: kept;
    rows alike in doc_id and text get the same result. Overlaps of different kinds all stay. Empty table: no rows. Other
    columns are ignored.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.xxhash64(body).alias("row"), body.alias("text"),
    )
    found = F.concat(*[_find(F.col("text"), k) for k in range(len(KINDS))])
    kept = rows.select("doc_id", "owner", "repository", "row", found.alias("found"))
    kept = materialize(spark, kept.withColumn("found", F.transform("found", lambda x: x.withField("digest", F.sha2(x["secret"], 256)))), "found")

    candidates = kept.where(F.size("found") > 0).select("doc_id", "row", "owner", "repository", F.explode("found").alias("x"))
    by_owner = candidates.select(F.col("x.digest").alias("digest"), "owner", "repository").distinct().groupBy("digest", "owner").agg(F.count("*").alias("repositories"))
    owners = materialize(spark, by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")), "owners")

    # A secret's own look: letters and digits, and long enough.
    looks = (F.char_length("x.secret") >= LIVE_CHARS) & F.rlike("x.secret", F.lit("[A-Za-z]")) & F.rlike("x.secret", F.lit("[0-9]"))
    narrow = candidates.select("doc_id", "row", F.col("x.digest").alias("digest"), looks.alias("looks"), F.struct("x.start", "x.end", "x.k", "x.secret").alias("x"))
    shared = (F.col("owners") >= shared_owners) | (F.col("repositories") >= shared_repositories)
    verdict = F.when(shared, "example").when(F.col("looks"), "live").otherwise("weak")
    judged = narrow.join(owners, "digest").withColumn("verdict", verdict)
    is_ = lambda v: F.when(F.col("verdict") == v, F.struct("x.start", "x.k"))
    sums = judged.groupBy("doc_id", "row").agg(
        F.collect_set(F.when((F.col("x.k") >= BASE) & (F.col("verdict") == "live"), F.col("x"))).alias("added"),
        *[F.size(F.collect_set(is_(v))).cast("long").alias(f"n_{v}") for v in ("live", "example", "weak")],
        F.array_sort(F.collect_set(F.when(F.col("verdict") == "live", F.col("digest")))).alias("live"),
    )
    sums = sums.select(F.col("doc_id").alias("of"), F.col("row").alias("of_row"), "added", "n_live", "n_example", "n_weak", "live")
    joined = kept.join(sums, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    base = F.filter("found", lambda x: x["k"] < BASE)
    plain = F.transform(base, lambda x: F.struct(x["start"], x["end"], x["k"], x["secret"]))
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return joined.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)], _shown(base).alias("base"),
        _shown(F.concat(plain, F.coalesce("added", F.expr(f"cast(array() as {_FOUND})")))).alias("spans"),
        *[F.coalesce(f"n_{v}", F.lit(0).cast("long")).alias(f"n_{v}") for v in ("live", "example", "weak")],
        F.coalesce("live", F.expr("cast(array() as array<string>)")).alias("live"),
    )
