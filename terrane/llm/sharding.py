"""Sharding by sampled splitters, in DataFrame operations only.

Records are ordered by (hash of the text, doc_id). Keys drawn with a probability in proportion to their size give
quantile boundaries, which cut the order into ranges of about equal bytes. Ranges are bounded in number, so what the driver
gathers is; in a large table each is cut evenly into steps of its keys, which are hashes. Steps that turn out overfull (a group
of equal texts has one key) are subdivided by a hash of doc_id and of the row's number, so that one row repeated many times is
spread too. Sums of the resulting cells, a table that grows with the rows, then place each record exactly on the scale of all
bytes, and the shard is the part of that scale on which the record's middle lies.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows aimed at in a step, ranges at least and at most, and sampled keys for each range: the driver gathers no more than
#: SAMPLES keys (on average) and two sums for each range, and a task sorts about as many rows as a step has.
STEP_ROWS, LEAST_RANGES, MOST_RANGES, SAMPLES = 32768, 64, 4096, 6


def _longs(values) -> Column:
    """A constant array, as one folded literal."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def _range_of(key: Column, splitters: list[int]) -> Column:
    """How many splitters are not above the key: a binary search inside one expression."""
    if not splitters:
        return F.lit(0).cast("int")
    steps = 1 << (len(splitters)).bit_length()
    padded = _longs(splitters)
    n = len(splitters)
    halves = []
    while steps:
        halves.append(steps)
        steps //= 2
    return F.aggregate(
        F.array(*[F.lit(h) for h in halves]),
        F.lit(0),
        lambda low, half: F.when((low + half <= n) & (F.get(padded, low + half - 1) <= key), low + half).otherwise(low),
    )


def splitters_of(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    """Boundaries at the quantiles of a weighted sample of keys: distinct, ascending."""
    if not sample:
        return []
    sample = sorted(sample)
    sums = list(accumulate(w for _, w in sample))
    out: list[int] = []
    for i in range(1, ranges):
        k = sample[min(bisect_right(sums, sums[-1] * i / ranges), len(sample) - 1)][0]
        if not out or k > out[-1]:
            out.append(k)
    return out


def _step_of(key: Column, bounds: list[int], range_: Column, steps: int) -> Column:
    """Which of the even steps between the bounds of its range a key is in: never less for a greater key."""
    if steps == 1:
        return F.lit(0)
    edges = _longs([-(2**63), *bounds, 2**63 - 1])
    low, high = F.get(edges, range_).cast("double"), F.get(edges, range_ + 1).cast("double")
    return F.least(F.lit(steps - 1), F.greatest(F.lit(0), F.floor((key.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * steps))).cast("int")


def shard(docs: DataFrame, shards: int = 16, step_rows: int = STEP_ROWS, most_ranges: int = MOST_RANGES) -> DataFrame:
    """Deal all rows into `shards` shards of near-equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 1; null text: 1), text_crc32, law ('bytes'), shard, slot (gapless
    from 0 in each shard), grown_shard (null). The sizes of two shards differ by less than the two longest records.
    Equal texts are neighbours in the order, so a group is spread over no more shards than its bytes need. Rows that
    repeat, null ids and null texts are rows like others; an empty table gives an empty result. Other columns are not
    looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = materialize(
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("k")).withColumn("tie", F.xxhash64("doc_id", F.lit(3))).withColumn("row", F.monotonically_increasing_id()),
        "sized",
    )
    rows, total = base.agg(F.count("*"), F.sum("size")).first()
    total = total or 1
    ranges = min(most_ranges, max(LEAST_RANGES, -(-rows // step_rows)))
    steps = max(1, -(-rows // (step_rows * ranges)))
    drawn = F.least(F.lit(1.0), F.col("size") * (ranges * SAMPLES / total))
    unit = F.pmod(F.xxhash64("k", "tie", "row", F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = [(r.k, r.w) for r in base.withColumn("p", drawn).filter(unit < F.col("p")).select("k", (F.col("size") / F.col("p")).alias("w")).collect()]
    splitters = splitters_of(sample, ranges)
    ranged = base.withColumn("range", _range_of(F.col("k"), splitters).cast("int")).withColumn("step", _step_of(F.col("k"), splitters, F.col("range"), steps))
    fair = max(1, total // (ranges * steps))
    overfull = ranged.groupBy("range", "step").agg(F.sum("size").alias("b")).filter(F.col("b") > 2 * fair).select("range", "step", F.ceil(F.col("b") / fair).cast("int").alias("parts"))
    celled = ranged.join(materialize(overfull, "overfull"), ["range", "step"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("tie", "row"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    # Rows and bytes before each cell: of its range by a running sum over the range's cells, of the ranges before it by a bounded array.
    cells = materialize(celled.groupBy("range", "step", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b")), "cells")
    sums = {r["range"]: (r["n"], r["b"]) for r in cells.groupBy("range").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()}
    before = [[0, *accumulate(sums.get(i, (0, 0))[k] for i in range(len(splitters)))] for k in (0, 1)]
    so_far = Window.partitionBy("range").orderBy("step", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [(F.get(_longs(before[k]), F.col("range")) + F.coalesce(F.sum(c).over(so_far), F.lit(0))).alias(f"{c}_before") for k, c in enumerate(("n", "b"))]
    cells = materialize(cells.select("range", "step", "part", *offsets), "offsets")
    inside = Window.partitionBy("range", "step", "part").orderBy("k", "tie", "doc_id", "row")
    placed = materialize(
        celled.join(cells, ["range", "step", "part"])
        .withColumn("rank", F.col("n_before") + F.row_number().over(inside) - 1)
        .withColumn("end", F.col("b_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("end") * 2 - F.col("size")) * shards / F.lit(2 * total))).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "rank"),
        "placed",
    )
    starts = dict(placed.groupBy("shard").agg(F.min("rank")).collect())
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.get(_longs([starts.get(i, 0) for i in range(shards)]), F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
