"""Secrets, judged by how widely a candidate is owned over the corpus; DataFrame operations only.

Patterns give candidates with their places. Hashes of the candidates are aggregated over all documents by distinct
repositories and owners: what many owners have, or what stands in many repositories even of few owners, is a copied example;
what belongs to few looks live. Candidates of the base kinds are always reported as spans; of the added kind (mixed strings
without a known form) only those that look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Kind, pattern, group that holds the secret, least length of that group. Fixed values of the base kinds.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: The added kind: long runs that mix capitals, small letters and digits.
ADDED = ("mixed", r"[A-Za-z0-9_-]{24,}", 0, 24)
#: From so many distinct owners, or so many distinct repositories, on, a candidate is a widely copied example. An owner may use
#: one live key in a few repositories of its own.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6


def _matches(text: Column, order: int, kind: tuple[str, str, int, int]) -> Column:
    """Matches of a kind in order, each with the length of the text between it and the one before."""
    _, pattern, group, _ = kind
    p = F.lit(pattern)
    whole, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, p, F.lit(group))
    found = F.transform(
        F.arrays_zip(whole.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(whole)).alias("g")),
        lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), x["v"].alias("value")),
    )
    return F.when(F.regexp_like(text, p), found).otherwise(F.array().cast("array<struct<ord:int,i:int,gap:int,len:int,value:string>>"))


def candidates(docs: DataFrame, repository: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """All rows (uid, doc_id), and all candidates: uid, doc_id, repository, owner, ord, start, end, value."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", repository.alias("repository"), owner.alias("owner"), F.concat(*[_matches(text, i, k) for i, k in enumerate((*KINDS, ADDED))]).alias("found"))
    rows = materialize(rows, "scanned")
    along = Window.partitionBy("uid", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.select("uid", "doc_id", "repository", "owner", F.explode("found").alias("f"))
        .select("uid", "doc_id", "repository", "owner", "f.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along))
        .withColumn("start", F.col("end") - F.col("len"))
    )
    long_enough = F.lit(False)
    for i, (_, _, _, least) in enumerate((*KINDS, ADDED)):
        long_enough = long_enough | ((F.col("ord") == i) & (F.length("value") >= least))
    mixed = F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[0-9]")
    placed = placed.filter(long_enough & ((F.col("ord") < len(KINDS)) | mixed))
    return rows.select("uid", "doc_id"), materialize(placed.select("uid", "doc_id", "repository", "owner", "ord", "start", "end", "value", F.sha2("value", 256).alias("hash")), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners (distinct, over the corpus), live."""
    by_owner = found.select("hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners")).withColumn("live", (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES))


def _judged(found: DataFrame) -> DataFrame:
    return found.join(materialize(ownership(found), "ownership"), "hash")


def scan_secrets(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Find secrets in every document.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, by start, then kind; code points, end
    exclusive), n_live (spans whose candidate looks live), most_owners and most_repositories (the largest of its candidates, 0
    without one), a row for each input row. The owner is the column `source` and the
    repository source and language, unless given. A null text is empty; null owners count as one owner; rows that repeat
    are scanned each and add no owner; an empty table gives an empty result.
    """
    owner = F.coalesce(F.col("source"), F.lit("")) if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    rows, found = candidates(docs, repository, owner)
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in (*KINDS, ADDED)]), F.col("ord") + 1)
    reported = _judged(found).filter((F.col("ord") < len(KINDS)) | F.col("live"))
    name = F.concat_ws(":", kind, F.col("start"), F.col("end"))
    spans = reported.groupBy("uid").agg(
        *[F.count_if(F.col("ord") == i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)], F.count_if("live").alias("n_live"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"), F.array_sort(F.collect_list(F.struct("start", "ord", "end", name.alias("name")))).alias("all")
    )
    joined = lambda a: F.array_join(F.transform(a, lambda x: x["name"]), ",")
    count = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return rows.join(spans, "uid", "left").select(
        "doc_id",
        *[count(f"n_{k[0]}") for k in KINDS],
        F.sha2(F.coalesce(joined(F.filter("all", lambda x: x["ord"] < len(KINDS))), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"),
        count("n_live"),
        count("most_owners"),
        count("most_repositories"),
    )


def redact_live(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each live-looking secret of a document replaced by a mark wherever it stands in it.

    Rows of one doc_id are one document: a secret of one text is masked in the others too. A row without doc_id is known by
    its text instead. Null and empty texts stay as they are, rows that repeat are masked each, an empty table stays empty.
    """
    unnamed = F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    keyed = docs.withColumn("doc_id", F.struct("doc_id", unnamed.alias("sha")))
    _, found = candidates(keyed, F.concat_ws("/", "source", "lang"), F.coalesce(F.col("source"), F.lit("")))
    hidden, of, sha = (unused(docs, c) for c in ("secrets", "of_doc", "of_text"))
    live = _judged(found).filter("live").groupBy(F.col("doc_id.doc_id").alias(of), F.col("doc_id.sha").alias(sha)).agg(F.array_sort(F.collect_set("value"), lambda a, b: F.length(b) - F.length(a)).alias(hidden))
    clean = F.aggregate(hidden, F.col("text"), lambda text, secret: F.replace(text, secret, F.lit(mark)))
    joined = docs.join(live, F.col("doc_id").eqNullSafe(F.col(of)) & unnamed.eqNullSafe(F.col(sha)), "left")
    return joined.select(*[F.when(F.col(hidden).isNull(), F.col("text")).otherwise(clean).alias("text") if c == "text" else F.col(c) for c in docs.columns])
