"""Fill-in-middle transformation: a text's middle moves to its end, behind marks.

Units (a run of letters, or one other character) are matched lazily and twice. The first pass counts them; the second advances
a fresh iterator of matches to the two ranks where the text is cut, and stops there. At any time one match exists, so memory
does not grow with the number of units. Only places come back from the Arrow batches; Spark cuts and joins the strings.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that are transformed, and of those with the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def count_units(text: str) -> int:
    """First pass: how many units there are."""
    counter = count()
    deque(zip(UNIT.finditer(text), counter), maxlen=0)
    return next(counter)


def cut_places(text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: ends, in code points, of the unit of rank `first` and of that of rank `second` (first <= second)."""
    matches = UNIT.finditer(text)
    low = next(islice(matches, first - 1, None)).end() if first else 0
    return low, next(islice(matches, second - first - 1, None)).end() if second > first else low


def _cut(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, one, two in texts:
        rows = []
        for t, a, b in zip(text, one.to_pylist(), two.to_pylist(), strict=True):
            t = t.as_py()
            n = count_units(t)
            a, b = a % (n + 1), b % (n + 1)
            rows.append((n, *cut_places(t, min(a, b), max(a, b))))
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
        yield pa.StructArray.from_arrays(columns, names=["n", "low", "high"])


def transform(docs: DataFrame, salt: str = "1", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output of every row.

    The hash of salt and doc_id draws the two cuts and the form, so a rerun gives the same rows in any order of the table. A null
    text counts as empty; empty texts and those that hold a mark stay plain; a row without doc_id is drawn as the empty id; rows
    that repeat give the same row each; an empty table gives an empty result; other columns, whatever their names, are not
    looked at. The map is narrow.
    """
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *drawn)
    cut = F.arrow_udf(_cut, "struct<n: long, low: long, high: long>")
    rows = rows.select("doc_id", "text", "h3", "h4", cut("text", "h1", "h2").alias("cut"))
    text, low, high = F.col("text"), F.col("cut.low"), F.col("cut.high")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (F.col("h3") % 100 >= changed), "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    before = F.substring(text, F.lit(1), low.cast("int"))
    middle = F.substring(text, (low + 1).cast("int"), (high - low).cast("int"))
    after = F.substring(text, (high + 1).cast("int"), F.length(text))
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), before, F.lit(SUFFIX), after, F.lit(MIDDLE), middle)).otherwise(F.concat(F.lit(SUFFIX), after, F.lit(PREFIX), before, F.lit(MIDDLE), middle))
    open_ = F.col("form") != "plain"
    return rows.withColumn("form", form).select("doc_id", F.col("cut.n").alias("n"), "form", F.when(open_, low).alias("prefix_chars"), F.when(open_, high - low).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text of an output, from the output and its form alone: marks occur once each, so they tell the parts."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", 4)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def transform_digest(docs: DataFrame) -> DataFrame:
    """What `transform` gives, with digests in place of the output and of the text that `restore` makes of it."""
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
