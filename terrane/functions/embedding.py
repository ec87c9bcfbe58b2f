"""Encoders of names: any model, loaded once in each worker, and one that is trained here.

The trained one is a truncated singular value decomposition of hashed character n-grams: counts weighted by rarity, of unit length; the
sum of their outer products over all names, added up by partition, has the right singular vectors as its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of n-grams, components of a vector, sizes of n-grams, and how many tasks add up outer products: each sends
#: 8 * BUCKETS**2 bytes, whatever the table's size.
BUCKETS, COMPONENTS, SIZES, TASKS = 1536, 384, (2, 3, 4), 32
#: Names that a model is given at a time.
BATCH = 256

Encode = Callable[[list[str]], np.ndarray]
_LOADED: dict[str, Encode] = {}


def _encoder(name: str, load: Callable[[], Encode]) -> Encode:
    """The worker's own model of a name."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def model_embedder(name: str, load: Callable[[], Encode], batch: int = BATCH) -> Callable[[Column], Column]:
    """A function of a column of names to vectors (array<float>, unit length; zeros for a blank name), for similarity.set_embedder.

    load is called once in each worker process, when its first name comes, and kept there under `name`; what it returns is given lists
    of at most `batch` names that are not blank, and returns their vectors as rows.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for names in batches:
            texts = [(t or "").strip() for t in names.to_pylist()]
            full = [i for i, t in enumerate(texts) if t]
            encode = _encoder(name, load)
            parts = [np.asarray(encode([texts[i] for i in full[a : a + batch]]), dtype=np.float32) for a in range(0, len(full), batch)]
            width = parts[0].shape[1] if parts else np.asarray(encode(["x"])).shape[1]
            out = np.zeros((len(texts), width), dtype=np.float32)
            if parts:
                rows = np.concatenate(parts)
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                out[full] = rows / np.where(norm > 0, norm, 1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * width, pa.int32()), pa.array(out.ravel(), pa.float32()))

    return lambda names: F.arrow_udf(run, "array<float>")(F.coalesce(names, F.lit("")))


def grams(names: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the n-grams of each name, lower-cased, with a space at both ends."""
    texts = [f" {name.strip().lower()} " for name in names]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    keys = []
    for n in SIZES:
        inside = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :])
        h = np.full(len(inside), 0xCBF29CE484222325 + n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ points[inside + k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        keys.append(owner[inside] * buckets + (h % np.uint64(buckets)).astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True) if names else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    return key // buckets, key % buckets, count


class SvdModel(NamedTuple):
    """Weight of each bucket, and the components: buckets by components."""

    weights: np.ndarray
    components: np.ndarray

    def rows(self, names: list[str]) -> np.ndarray:
        """Weighted n-grams of unit length."""
        row, bucket, count = grams(names, len(self.weights))
        out = np.zeros((len(names), len(self.weights)))
        out[row, bucket] = (1 + np.log(count)) * self.weights[bucket]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def encode(self, names: list[str]) -> np.ndarray:
        return self.rows(names) @ self.components


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    for batch in batches:
        for first in range(0, batch.num_rows, 1024):
            yield [t for t in batch.column(0).slice(first, 1024).to_pylist() if t and t.strip()]


def train_svd(names: DataFrame, column: str, components: int = COMPONENTS, buckets: int = BUCKETS) -> SvdModel:
    """Fit on every name of a column that is not blank. What reaches the driver is `buckets` sums, then `buckets` rows of as many."""
    told = names.select(F.col(column).cast("string").alias("name"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets + 1, dtype=np.int64)
        for some in _texts(batches):
            sums[:-1] += np.bincount(grams(some, buckets)[1], minlength=buckets)
            sums[-1] += len(some)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 1)), pa.array(sums)], names=["bucket", "n"])

    df = np.zeros(buckets + 1)
    for r in told.mapInArrow(held, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        df[r["bucket"]] = r["n"]
    weights = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1
    model = SvdModel(weights, np.zeros((buckets, 0)))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets, buckets))
        for some in _texts(batches):
            x = model.rows(some)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array([r.tobytes() for r in total], pa.binary())], names=["bucket", "sums"])

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "sums": [np.sum([np.frombuffer(r) for r in rows["sums"]], axis=0).tobytes()]})

    partial = told.coalesce(TASKS).mapInArrow(products, "bucket long, sums binary")
    gram = np.zeros((buckets, buckets))
    for r in partial.groupBy("bucket").applyInPandas(added, "bucket long, sums binary").collect():
        gram[r["bucket"]] = np.frombuffer(r["sums"])
    values, vectors = np.linalg.eigh(gram)
    top = np.argsort(-values)[: min(components, buckets)]
    return SvdModel(weights, vectors[:, top])


def svd_embedder(model: SvdModel, name: str = "svd") -> Callable[[Column], Column]:
    """The trained model as an embedder; it travels with the function, which is bounded by buckets and components."""
    return model_embedder(f"{name}-{hash(model.components.tobytes())}", lambda: model.encode)


def save_model(spark: SparkSession, model: SvdModel, path: str) -> None:
    """As a table of one row in a folder that Spark reads."""
    row = (model.weights.astype("<f8").tobytes(), model.components.astype("<f8").tobytes(), len(model.weights))
    spark.createDataFrame([row], "weights binary, components binary, buckets int").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> SvdModel:
    row = spark.read.parquet(path).first()
    return SvdModel(np.frombuffer(row["weights"], dtype="<f8"), np.frombuffer(row["components"], dtype="<f8").reshape(row["buckets"], -1))
