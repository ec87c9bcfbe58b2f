"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Each text, lower-cased in A-Z, is cut into blocks of a fixed number of bytes. Equal blocks get one integer name, then
adjacent pairs of names get names of their own, level by level, until one name is left for each document. A name is the
pair (hash of what it names, rank of it among all different contents of that hash in sorted order): two contents never
share a name, whatever the hash does, since contents of one hash are compared as they are.

A block whose hash occurs once in the corpus has no equal, so its content need not travel; the contents of all others
are shuffled once and compared. Only the contents of a hash that has several are sorted, ranked and joined again. Every
level is written to the shared folder once, so no level is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, sorted_side, unused

BLOCK_BYTES = 16384


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """doc_id, sha, n (blocks of the text), idx, h, block."""
    data = F.col("t").cast("binary")
    return (
        docs.select(F.col("doc_id"), lower_ascii(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
        .withColumn("n", F.greatest(F.lit(1), F.ceil(F.octet_length("t") / F.lit(block_bytes)).cast("int")))
        .select("doc_id", F.sha2(data, 256).alias("sha"), "n", "t", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
        .select("doc_id", "sha", "n", "idx", F.substring(data, F.col("idx") * block_bytes + 1, F.lit(block_bytes)).alias("block"))
        .withColumn("h", _hash(F.col("block")))
    )


def _several(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The hashes with more than one content, written: hardly ever any."""
    return materialize(rows.select("h", *keys).distinct().groupBy("h").count().filter("count > 1").select("h"), name)


def _ranked(rows: DataFrame, several: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The different contents of these hashes with their rank among those of the same hash, written."""
    distinct = rows.join(several, "h", "left_semi").select("h", *keys).distinct()
    return materialize(distinct.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(*keys)) - 1), name)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def block_names(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, sha (of the normalised text), times, n, h, r; (n, h, r) is the identity of the text. One row per input row, but
    equal rows of more than one block are one, that came so many times. Read from written tables, with nothing in between."""
    plain = docs.select("doc_id", "text")
    rows = materialize(_blocks(plain, block_bytes).drop("block"), "blocks")
    repeated = materialize(rows.groupBy("h").count().filter("count > 1").select("h"), "repeated-hashes")
    some = materialize(_blocks(plain, block_bytes).join(repeated, "h", "left_semi"), "repeated")
    several = _several(some, ["block"], "several")
    level = rows.withColumn("r", F.lit(0))
    if not several.isEmpty():
        names = _ranked(some, several, ["block"], "names")
        ranks = some.join(names, ["h", "block"]).select("doc_id", "sha", "idx", "r").distinct()
        level = materialize(rows.join(ranks, on=_same(rows, ranks, ["doc_id", "sha", "idx"]), how="left").select(rows["*"], F.coalesce(ranks.r, F.lit(0)).alias("r")), "level")
    # A repeated row of the input repeats its blocks; where there are several, they meet in the first grouping and are counted.
    level = level.withColumns({"left": F.col("n"), "times": F.lit(1).cast("long")})
    done = level.filter("left = 1").drop("left", "idx")
    depth = 0
    level = level.filter("left > 1")
    while not level.isEmpty():
        depth += 1
        first = F.col("idx") % 2 == 0
        pairs = level.groupBy("doc_id", "sha", "n", "left", F.floor(F.col("idx") / 2).cast("int").alias("half")).agg(
            F.max(F.when(first, F.struct("h", "r"))).alias("a"), F.max(F.when(~first, F.struct("h", "r"))).alias("b"), F.sum(F.when(first, F.col("times"))).alias("times")
        )
        pairs = materialize(
            pairs.select("doc_id", "sha", "times", "n", F.ceil(F.col("left") / 2).cast("int").alias("left"), F.col("half").alias("idx"), F.col("a.h").alias("ah"), F.col("a.r").alias("ar"), F.col("b.h").alias("bh"), F.col("b.r").alias("br"))
            .withColumn("h", _hash(F.col("ah"), F.col("ar"), F.coalesce("bh", F.lit(0)), F.coalesce("br", F.lit(-1)))),
            f"pairs{depth}",
        )
        keys = ["ah", "ar", "bh", "br"]
        several = _several(pairs, keys, f"several{depth}")
        level = pairs.withColumn("r", F.lit(0))
        if not several.isEmpty():
            names = _ranked(pairs, several, keys, f"names{depth}")
            level = materialize(pairs.join(names, on=_same(pairs, names, ["h", *keys]), how="left").select(pairs["*"], F.coalesce(names.r, F.lit(0)).alias("r")), f"level{depth}")
        level = level.drop(*keys)
        done = done.unionByName(level.filter("left = 1").drop("left", "idx"))
        level = level.filter("left > 1")
    return done


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Group equal texts (after lower-casing A-Z); of a group the largest doc_id stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row for each input row. A null text is the empty text; a
    null doc_id never stays while its group has another; rows that repeat a doc_id and its text come back as often as
    they came, each counted, all kept if their doc_id stays. An empty table gives an empty result. Other columns of
    the input are not looked at.
    """
    named = block_names(docs, block_bytes)
    groups = materialize(named.groupBy("n", "h", "r").agg(F.max("doc_id").alias("keep_id"), F.sum("times").alias("group_size")), "groups")
    return (
        named.join(groups, ["n", "h", "r"])
        .withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without copies: of each group of equal texts (see exact_dedup) the row of the largest
    doc_id stays, and one row of it where the row repeats. Null texts are the empty text; a group without any doc_id keeps one
    row of each of its spellings' hashes, which is one.
    """
    judged = exact_dedup(docs).groupBy("doc_id", "kept", "text_sha256").agg(F.count("*").alias("times"))
    judged = materialize(judged.filter("NOT kept OR times > 1"), "judged")
    of, sha, own = unused(docs, "of"), unused(docs, "sha"), unused(docs, "own_sha")
    rows = docs.withColumn(own, F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256))
    named = lambda some: some.select(F.col("doc_id").alias(of), F.col("text_sha256").alias(sha))
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(own) == F.col(sha))
    left = rows.join(sorted_side(named(judged.filter("NOT kept"))), same, "left_anti")
    again = judged.filter("kept")
    if not again.isEmpty():
        once = left.join(named(again), same, "left_semi").dropDuplicates(["doc_id", own])
        left = left.join(named(again), same, "left_anti").unionByName(once)
    return left.select(*docs.columns)
