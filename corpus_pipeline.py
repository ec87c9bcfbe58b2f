"""A corpus pipeline: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrane.llm.common import materialize, table
from terrane.llm.exact_dedup import drop_copies
from terrane.llm.ngram_join import drop_near_copies
from terrane.llm.packing import pack
from terrane.llm.quality import keep_good
from terrane.llm.secret_scan import redact_live
from terrane.plans.scratch import discard_since, mark

#: Near copies here: runs of so many words, and the least Jaccard similarity in percent. op3_ngram_join has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.

    Every row is scored by its whole text, also one without doc_id; a null text counts as empty; rows that repeat get one
    score and stay or go together. Without labels every row stays. An empty table stays empty. Other columns, whatever
    their names, are handed through.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, after lower-casing A-Z: that of the largest doc_id, once.

    Null and empty texts are one group; a row without doc_id stays only where no row of its group has one; rows that repeat
    are one. Rows of one doc_id with different texts are judged each by its text. An empty table stays empty. Other columns,
    whatever their names, are handed through.
    """
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, once.

    Rows without words (null and empty texts among them) and rows without doc_id have no near duplicates: all stay. Rows of
    one doc_id with different texts are judged each by its text; where several texts of the smallest doc_id are in one group,
    the one of the smallest hash stays. An empty table stays empty. Other columns, whatever their names, are handed through.
    """
    return drop_near_copies(docs, NEAR_WORDS, NEAR_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, live-looking secrets masked.

    Null and empty texts stay as they are; a row without doc_id is known by its text; rows that repeat are masked each; a
    secret found in one text of a doc_id is masked in its other texts too. Null sources count as one owner. An empty table
    stays empty. Other columns, whatever their names, are handed through.
    """
    return redact_live(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences.

    A null or empty text is the closing id alone; rows without doc_id and rows that repeat are packed each; a long text is
    cut into pieces. An empty table gives no pieces. Other columns are left out: the rows are pieces.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the classifier, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents. What a stage has written on the way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    began = mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard_since(spark, began, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
