"""Quality scores of documents by random Fourier features.

Statistics of whole texts are mapped by random Fourier features, which approximate a Gaussian kernel; ridge regression on
the labels is solved from normal equations summed over partitions; isotonic regression on labelled rows that took no part
in the fit turns its values into scores from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, materialize, word_hashes

#: Fourier features, ridge weight, labelled rows at most (the fit's documented bound), partial sums, isotonic bins.
FEATURES, RIDGE, MAX_LABELLED, PARTIALS, BINS = 384, 1e-3, 2_000_000, 12, 2048

_CLASS = np.full(256, 0, dtype=np.int64)  # 0: letters, other bytes
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 11, 12, 13]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 8
STATISTICS = 18


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics for each text, over all of it."""
    out = np.zeros((len(texts), STATISTICS))
    for first, last in chunks(texts):
        out[first:last] = _statistics(texts[first:last])
    return out


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    hashes, owner, starts, ends, buffer = word_hashes(texts, lower=False)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=n)
    kinds = _CLASS[buffer]
    byte_owner = np.repeat(np.arange(n), sizes + 1)
    count = np.bincount(byte_owner * 9 + kinds, minlength=9 * n).reshape(n, 9).astype(np.float64)
    count[:, 3] -= 1  # the space that joins the texts
    words = np.bincount(owner, minlength=n).astype(np.float64)
    lengths = (ends - starts).astype(np.float64)
    some, filled = np.maximum(words, 1), np.maximum(sizes, 1)
    mean = np.bincount(owner, lengths, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(owner, lengths * lengths, n) / some - mean * mean))
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(fresh), len(h)))
    most = np.zeros(n)
    np.maximum.at(most, o[fresh], runs)

    def echoes(back: int) -> np.ndarray:
        same = (hashes[back:] == hashes[:-back]) & (owner[back:] == owner[:-back])
        return np.bincount(owner[back:][same], minlength=n)

    last, firstb = buffer[ends - 1], buffer[starts]
    share = lambda mask: np.bincount(owner[mask], minlength=n) / some
    letters = np.maximum(1, count[:, 0] + count[:, 1])
    return np.column_stack([
        np.log1p(sizes), np.log1p(words), np.minimum(mean, 40), np.minimum(spread, 40), count[:, 1] / letters, count[:, 2] / filled, count[:, 4] / some, count[:, 5] / filled,
        np.minimum(count[:, 6] / some, 1), np.minimum(count[:, 7] / some, 1), np.minimum(count[:, 8] / some, 4), distinct / some * (words > 0), most / some, echoes(1) / some, echoes(2) / some,
        share(_CLASS[last] == 6), share((_CLASS[last] == 8) | (_CLASS[last] == 7)), share(_CLASS[firstb] == 1),
    ])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            x = statistics(as_bytes(part.column(1)))
            flat = pa.array(x.ravel(), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, STATISTICS), pa.int32()), flat)], names=["doc_id", "x"])


class Fourier:
    """The map z(x) = cos(w x + b), after scaling by the labelled rows' mean and deviation."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int = 20240607) -> None:
        random = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.deviation = mean, deviation
        self.w = random.standard_normal((len(mean), features)) / width
        self.b = random.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.deviation, -8, 8) @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.column_stack([z, np.ones(len(x))])


def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(batch.column(name).flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def _sums(fourier: Fourier):
    """Normal equations of a partition: one row."""
    size = len(fourier.b) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            z, y = fourier(_rows(batch, "x")), np.asarray(batch.column("y"), dtype=np.float64)
            a += z.T @ z
            b += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([a.ravel().tolist()], pa.list_(pa.float64())), pa.array([b.tolist()], pa.list_(pa.float64()))], names=["a", "b"])

    return run


def isotonic(values: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the levels' values in ascending order and their non-decreasing means."""
    at, mean, weight = [], [], []
    for i in np.argsort(values, kind="stable"):
        at.append([values[i] * weights[i]])
        mean.append(targets[i])
        weight.append(weights[i])
        while len(mean) > 1 and mean[-2] >= mean[-1]:
            w = weight[-2] + weight[-1]
            mean[-2] = (mean[-2] * weight[-2] + mean[-1] * weight[-1]) / w
            at[-2][0] += at[-1][0]
            weight[-2] = w
            at.pop(), mean.pop(), weight.pop()
    return np.asarray([a[0] / w for a, w in zip(at, weight, strict=True)]), np.asarray(mean)


class QualityModel:
    """A fitted classifier: arrays of a fixed size, so it travels with each task."""

    def __init__(self, fourier: Fourier | None = None, weights: np.ndarray | None = None, at: np.ndarray | None = None, mean: np.ndarray | None = None) -> None:
        self.fourier, self.weights, self.at, self.mean = fourier, weights, at, mean

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 of rows of statistics; 0.5 without a fit."""
        if self.fourier is None:
            return np.full(len(x), 0.5)
        raw = self.fourier(x) @ self.weights
        return np.clip(np.interp(raw, self.at, self.mean) if len(self.at) else raw, 0, 1)


def _score(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_rows(batch, "x")))], names=["doc_id", "score"])

    return run


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))


def taught_labels(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, y: labels that may teach (crc32 of doc_id as text mod 3 is not 1), at most about max_labelled of them."""
    marks = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    taught = marks.filter(_remainder() != 1)
    known = taught.count()
    if known > max_labelled:
        taught = taught.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int((1 << 30) * max_labelled / known)))
    return taught


def fit_quality(measured: DataFrame, taught: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> QualityModel:
    """Fit to labelled rows: remainder 0 of crc32(doc_id as text) mod 3 fits the ridge, remainder 2 the curve."""
    rows = materialize(measured.join(taught, "doc_id").withColumn("fold", _remainder()).select("fold", "x", "y").repartition(PARTIALS), "labelled")
    moments = rows.filter("fold = 0").agg(F.count("*"), *[F.avg(F.get("x", F.lit(i))) for i in range(STATISTICS)], *[F.stddev_pop(F.get("x", F.lit(i))) for i in range(STATISTICS)]).first()
    if not moments[0]:
        return QualityModel()
    deviation = np.asarray(moments[1 + STATISTICS :], dtype=np.float64)
    fourier = Fourier(np.asarray(moments[1 : 1 + STATISTICS], dtype=np.float64), np.where(deviation > 1e-9, deviation, 1.0), features, width=np.sqrt(STATISTICS))
    parts = rows.filter("fold = 0").select("x", "y").mapInArrow(_sums(fourier), "a array<double>, b array<double>").toArrow()
    a = np.asarray(parts["a"].combine_chunks().flatten()).reshape(-1, features + 1, features + 1).sum(axis=0)
    b = np.asarray(parts["b"].combine_chunks().flatten()).reshape(-1, features + 1).sum(axis=0)
    weights = np.linalg.solve(a + ridge * max(1.0, float(moments[0]) / (features + 1)) * np.eye(features + 1), b)
    known = rows.filter("fold = 2").select(F.col("y").alias("doc_y"), "x").mapInArrow(_raw(fourier, weights), "y double, raw double")
    bins = known.groupBy(F.round(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * (BINS / 2)).alias("bin")).agg(F.avg("raw").alias("at"), F.avg("y").alias("mean"), F.count("*").alias("n")).orderBy("bin").collect()
    at, mean = isotonic(np.asarray([r["at"] for r in bins]), np.asarray([r["mean"] for r in bins]), np.asarray([float(r["n"]) for r in bins])) if bins else (np.zeros(0), np.zeros(0))
    return QualityModel(fourier, weights, at, mean)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure, "doc_id long, x array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Score every document; labels teach only where crc32(doc_id as text) mod 3 is not 1.

    Returns doc_id, held_out, score (0 to 1), predicted (1 from 0.5). At most about `max_labelled` labelled rows take part,
    drawn by a hash of doc_id. Null texts count as empty and are scored; null labels teach nothing; rows that repeat are
    scored each; without labels every score is 0.5; an empty table gives an empty result. Label, language, source and id
    are no inputs of a score; other columns are not looked at.
    """
    measured = materialize(measure(docs), "statistics")
    model = fit_quality(measured, taught_labels(labels, max_labelled), features, ridge)
    scored = measured.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more. Scores come from the text in the same narrow map.

    All rows are measured for the fit: to find the labelled ones first would move every text. Null and empty texts are scored
    like others, rows that repeat each; without labels every row stays; an empty table stays empty.
    """
    model = fit_quality(materialize(measure(docs), "statistics"), taught_labels(labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                yield part.filter(pa.array(model.score(statistics(as_bytes(part.column(place)))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def _raw(fourier: Fourier, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_y"), pa.array(fourier(_rows(batch, "x")) @ weights)], names=["y", "raw"])

    return run
