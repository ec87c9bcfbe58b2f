"""Ranked lexical search: impact-ordered, score at a time.

Items are taken in blocks of bounded bytes. For a block, one narrow pass over the documents counts the block's terms in each text
and writes them as a table (document, length, terms, counts); sizes and document frequencies are sums over that table. The
second pass is over the written table: every task indexes its own documents, so a term that all documents hold is spread over all tasks
and no posting is ever shuffled. A posting's share of a score is an integer, its impact. The postings of a term lie in descending order of
impact, those of one impact together, and for each item the lists are processed from the highest impact down, a step at a time,
into one accumulator for each document. What is still to come of each list bounds what any document can gain. Once the bounds leave
no more documents than the k best, the item is proven: their scores are completed from their own postings, the rest is never
looked at. Otherwise the lists are read to their ends. Each task returns at most k documents an item, and the best of all tasks are
ranked.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a block of items; bytes of a text whose terms are counted at once; documents and postings that a task indexes at once.
ITEM_BYTES, SLICE_BYTES, BLOCK_DOCS, BLOCK_POSTINGS = 1 << 20, 4 << 20, 1 << 16, 1 << 22
#: A step takes the impacts of one power of two; so many there are.
LEVELS = 63
POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, item_id long, doc_id long, score long"

#: Bytes of terms as they are or lower-cased, others as spaces; every byte of a character beyond ASCII belongs to a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def _term_lists(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in order, in lists of bounded bytes."""
    text = text.translate(_TERM_BYTES)
    if len(text) <= SLICE_BYTES:
        yield text.split()
        return
    start = 0
    while start < len(text):
        end = text.find(b" ", start + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class Terms(NamedTuple):
    """The terms of a block of items: number of each, and for each item its id and term numbers."""

    number: dict[bytes, int]
    items: list[tuple[int | None, np.ndarray]]


def number_terms(items: list[Row]) -> Terms:
    number: dict[bytes, int] = {}
    out = []
    for item in items:
        held = {number.setdefault(t, len(number)) for terms in _term_lists((item["text"] or "").encode()) for t in terms}
        out.append((item["item_id"], np.array(sorted(held), dtype=np.int64)))
    return Terms(number, out)


def _blocks(items: DataFrame, limit: int) -> Iterator[list[Row]]:
    """Items in blocks of about `limit` bytes, streamed through the driver one partition after another."""
    block, size = [], 0
    for item in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).distinct().toLocalIterator():
        more = len(item["text"] or "") * 4 + 64
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append(item)
        size += more
    if block:
        yield block


def _count_terms(number: dict[bytes, int]):
    """n of every document and, of the numbered terms, those that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = number.get
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                lengths, sizes, terms, counts = [], [0], [], []
                for text in part.column(1):
                    n, held = 0, Counter()
                    for some in _term_lists(text.as_buffer().to_pybytes() if text.is_valid else b""):
                        n += len(some)
                        held.update(map(find, some))
                    held.pop(None, None)
                    lengths.append(n)
                    terms.extend(held.keys())
                    counts.extend(held.values())
                    sizes.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


class Index:
    """Postings of some documents, by term and then by descending impact."""

    def __init__(self, doc_ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, docs: int, length: int) -> None:
        """sizes: postings of each document, whose terms and counts follow one another."""
        self.doc_ids, self.starts = doc_ids, np.concatenate(([0], np.cumsum(sizes)))
        shorter = 100 - 90 + (90 * n * docs) // length
        owner = np.repeat(np.arange(len(n)), sizes)
        self.doc_terms, tf = terms.astype(np.int64), counts.astype(np.int64)
        self.doc_impacts = weights[self.doc_terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * shorter[owner]))
        order = np.lexsort((-self.doc_impacts, self.doc_terms))
        self.owner, self.impacts = owner[order], self.doc_impacts[order]
        by_term = self.doc_terms[order]
        levels = np.frexp(self.impacts.astype(np.float64))[1]  # 2**(level - 1) <= impact < 2**level
        held = np.zeros((LEVELS + 2, len(weights)), dtype=np.int32)
        np.add.at(held, (levels, by_term), 1)
        #: edge[l, t]: where the list of term t goes below level l; in the last row, where it begins.
        self.edge = np.cumsum(held[::-1], axis=0, dtype=np.int32)[::-1]
        self.edge += np.concatenate(([0], np.cumsum(self.edge[0])[:-1])).astype(np.int32)
        self.next = np.append(self.impacts, 0)
        self.end = self.edge[0]
        self.wanted = np.zeros(len(weights), dtype=bool)
        self.read = 0

    def top(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of an item (places here, scores), but for those that score less than floor."""
        gained = np.zeros(len(self.doc_ids), dtype=np.int64)
        end, remaining = self.end[terms], 0
        for level in range(LEVELS, -1, -1):
            first, last = self.edge[level + 1, terms], self.edge[level, terms]
            sizes = last - first
            if not sizes.any():
                continue
            take = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            np.add.at(gained, self.owner[take], self.impacts[take])
            self.read += len(take)
            remaining = int(np.where(last < end, self.next[np.minimum(last, len(self.impacts))], 0).sum())
            least = max(floor, 1, int(np.partition(gained, -k)[-k]) if len(gained) > k else 0)
            if not remaining:
                break
            if remaining < least:  # who has gained nothing yet is out
                able = np.flatnonzero(gained + remaining >= least)
                if len(able) <= k:
                    scores = self.complete(able, terms)
                    return able[scores >= floor], scores[scores >= floor]
        best = np.flatnonzero(gained >= max(floor, 1, int(np.partition(gained, -k)[-k]) if len(gained) > k else 0))
        return best, gained[best]

    def complete(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Scores of documents from their own postings."""
        self.wanted[terms] = True
        out = np.array([self.doc_impacts[a:b][self.wanted[self.doc_terms[a:b]]].sum() for a, b in zip(self.starts[docs], self.starts[docs + 1], strict=True)], dtype=np.int64)
        self.wanted[terms] = False
        return out


#: In place of a missing doc_id, after all others among equal scores.
_NO_ID = np.iinfo(np.int64).max


def _search(items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, docs: int, length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)) for _ in items]

        def merge(some: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(some).combine_chunks()
            ids, n, terms, counts = (c.chunk(0) for c in table.columns)
            missing = np.asarray(ids.is_null())
            sizes = np.diff(np.asarray(terms.offsets)).astype(np.int64)
            index = Index(np.where(missing, _NO_ID, np.asarray(ids.fill_null(0))), np.asarray(n), sizes, np.asarray(terms.flatten()), np.asarray(counts.flatten()), weights, docs, length)
            for i, (_, wanted) in enumerate(items):
                old_ids, old_scores, old_missing = best[i]
                at, scores = index.top(wanted, k, int(old_scores[-1]) if len(old_scores) == k else 0)
                if len(at):
                    new_ids, new_scores, new_missing = np.concatenate((old_ids, index.doc_ids[at])), np.concatenate((old_scores, scores)), np.concatenate((old_missing, missing[at]))
                    order = np.lexsort((new_missing, new_ids, -new_scores))[:k]
                    order = order[new_scores[order] > 0]
                    best[i] = new_ids[order], new_scores[order], new_missing[order]

        held, docs_held, postings_held = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            docs_held += batch.num_rows
            postings_held += len(batch.column(2).flatten())
            if docs_held >= BLOCK_DOCS or postings_held >= BLOCK_POSTINGS:
                merge(held)
                held, docs_held, postings_held = [], 0, 0
        if held:
            merge(held)
        number = np.repeat(np.arange(len(items)), [len(b[0]) for b in best])
        if len(number):
            ids, scores, missing = (np.concatenate(x) for x in zip(*best, strict=True))
            item_ids = [items[i][0] for i in number.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(item_ids, pa.int64()), pa.array(ids, pa.int64(), mask=missing), pa.array(scores, pa.int64())], names=["item", "item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k highest-scoring documents of each item, if they score above 0.

    Every whole text counts in the statistics and can be found. A null or empty text, or one without terms, has no part in either; an
    item without terms, or whose terms no document holds, finds nothing. Equal scores are ranked by ascending doc_id, rows without one
    last. Rows of documents that repeat are documents of their own; rows of items that repeat are one, and different texts of one
    item_id are ranked each. Empty tables give an empty result. Other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, item_bytes):
        terms = number_terms(block)
        counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count_terms(terms.number), POSTINGS)
        postings = materialize(counted.filter(F.col("n") > 0), "postings")
        size = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
        if not size["docs"]:
            continue
        frequency = np.zeros(len(terms.number), dtype=np.int64)  # as long as the block's terms, so bounded like it
        for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            frequency[row["term"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64)
        found = postings.filter(F.size("terms") > 0).mapInArrow(_search(terms.items, weights, size["docs"], size["length"], k), FOUND)
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        out = out.unionByName(found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return out
