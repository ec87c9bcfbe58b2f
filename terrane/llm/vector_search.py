"""Nearest neighbours by cells and randomly rotated one-bit codes.

Vectors fall into cells around centroids, which are fitted on a bounded sample; every vector is indexed, in the cell of its
nearest centroid. A cell that holds too many is split again, by centroids fitted on a bounded sample of its own, so cells keep
their size however large the table is. A query meets the cells whose centroids are nearest to it, as many as the same samples
need for their own neighbours. There each vector is known by a code: the unit vector, padded with zeros and rotated by one random orthogonal
matrix, kept as the signs of its components packed in bits, and one scalar, the inner product of the vector and its own code.
Inner products with a query are estimated from counted bits: the rotated query is rounded to a few bits a component, and each
of its bit planes meets the code by a bitwise and. Only vectors whose upper error bound reaches the best lower bounds are
compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of a code at least (and one for each dimension), bit planes of a rounded query, error bound in units of the
#: estimator's deviation.
BITS, PLANES, EPSILON = 512, 4, 2.5
#: Rows aimed at in a cell; vectors and bytes of the sample that cells are fitted on; sampled vectors for each cell; rounds.
CELL_ROWS, SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_PER_CELL, ROUNDS = 4096, 16384, 64 << 20, 16, 8
#: Times that cells may be split again, and the most parts of one.
SPLITS, PARTS = 4, 1024
#: Share of the sample's neighbours that the probed cells must hold, and sampled queries that this is measured with.
FOUND, TRIALS = 0.97, 512
#: Rows and queries of a tile.
TILE_ROWS, TILE_QUERIES = 8192, 4096


def length_of(dim: int) -> int:
    """Bits of a code, in whole 64-bit words."""
    return max(BITS, -(-dim // 64) * 64)


@lru_cache(maxsize=4)
def rotation(dim: int, length: int, seed: int = 20240607) -> np.ndarray:
    """The first `dim` columns of a random orthogonal matrix of `length` rows, the same everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((length, dim)))
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of rotated unit vectors, packed in 64-bit words, and the inner product of each with its own code."""
    turned = units @ turn.T
    return np.packbits(turned > 0, axis=1).view(np.uint64), np.abs(turned).sum(axis=1) / np.sqrt(len(turn))


def estimate(query: np.ndarray, codes: np.ndarray, ones: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of a rotated unit query with coded unit vectors, and their deviations.

    codes are words by vectors, ones their counted bits. The query's components become integers of PLANES bits.
    """
    length = len(query)
    low = query.min()
    step = max((query.max() - low) / (2**PLANES - 1), 1e-12)
    rounded = np.rint((query - low) / step).astype(np.uint8)
    counted = np.zeros(codes.shape[1], dtype=np.int64)
    for plane in range(PLANES):
        words = np.packbits(rounded >> plane & 1).view(np.uint64)
        count = np.zeros(codes.shape[1], dtype=np.uint16)
        for word, of_rows in zip(words, codes, strict=True):
            count += np.bitwise_count(of_rows & word)
        counted += count.astype(np.int64) << plane
    inner = 2 * (low * ones + step * counted) - query.sum()
    spread = np.sqrt(np.maximum(0.0, 1 - scalars * scalars) / max(1, length - 1) + step * step / 12) / scalars
    return inner / (np.sqrt(length) * scalars), spread


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, scaled, and their squared lengths."""
    rows = np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), dtype=np.float64).reshape(len(column), -1)
    # A power of two changes no digit of a cosine and keeps squares in range.
    scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return scaled, _dot(scaled, scaled)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added in the order of the components, so a pair's value is the same wherever it is met."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


# --------------------------------------------------------------------------- cells


class Cells:
    """Centroids of the vectors of one length, and how many a query probes: arrays of a bounded size."""

    def __init__(self, centroids: np.ndarray, probes: int) -> None:
        self.centroids, self.probes = centroids, probes

    def nearest(self, units: np.ndarray, count: int) -> np.ndarray:
        """The `count` nearest cells of each unit vector, nearest first."""
        if len(self.centroids) == 1:
            return np.zeros((len(units), 1), dtype=np.int64)
        return np.argsort(-(units @ self.centroids.T), axis=1, kind="stable")[:, :count]


def fit_cells(units: np.ndarray, count: int, k: int, found: float = FOUND) -> Cells:
    """Spherical k-means on a sample, and the probes that hold `found` of the sample's own k nearest neighbours.

    Neighbours within a sample are further off than those in the whole table, so they lie in further cells if anything.
    """
    if count <= 1 or len(units) <= count:
        return Cells(np.zeros((1, units.shape[1])), 1)
    random = np.random.Generator(np.random.PCG64(20240607))
    centroids = units[random.permutation(len(units))[:count]].copy()
    for _ in range(ROUNDS):
        cell = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, units)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids)
    cell = (units @ centroids.T).argmax(axis=1)
    trials = random.permutation(len(units))[:TRIALS]
    likeness = units[trials] @ units.T
    likeness[np.arange(len(trials)), trials] = -2
    near = np.argpartition(-likeness, min(k, len(units) - 1) - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(units[trials] @ centroids.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(rank[np.arange(len(trials))[:, None], cell[near]].ravel())
    return Cells(centroids, int(ranks[min(len(ranks) - 1, int(np.ceil(found * len(ranks))) - 1)]) + 1)


def _fitted(rows: DataFrame, k: int, cell_rows: int) -> dict[int, Cells]:
    """Cells for each length of vectors that has more than one cell's rows; each from a sample of bounded rows and bytes."""
    out = {}
    for dim, n in rows.groupBy("dim").count().filter(F.col("count") > cell_rows).collect():
        most = min(SAMPLE_ROWS, max(256, SAMPLE_BYTES // (8 * dim)))
        drawn = rows.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, most / n)))))
        sample, norm = _units(drawn.select("v").toArrow()["v"])
        out[dim] = fit_cells(sample / np.sqrt(norm)[:, None], min(-(-n // cell_rows), len(sample) // SAMPLE_PER_CELL), k)
    return out


def _by_length(batch: pa.RecordBatch):
    """Rows of a batch by length of their vectors: places, unit vectors."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        scaled, norm = _units(batch.column("v").take(pa.array(at)))
        yield int(dim), at, scaled / np.sqrt(norm)[:, None]


def _coded(cells: dict[int, Cells]):
    """Each vector with its cell, code and scalar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, scalars, codes = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows), [b""] * batch.num_rows
            for dim, at, units in _by_length(batch):
                packed, scalars[at] = encode(units, rotation(dim, length_of(dim)))
                for i, code in zip(at.tolist(), packed, strict=True):
                    codes[i] = code.tobytes()
                if dim in cells:
                    cell[at] = cells[dim].nearest(units, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "dim")), pa.array(cell), pa.array(codes, pa.binary()), pa.array(scalars)], names=["vec_id", "v", "dim", "cell", "code", "scalar"])

    return run


def _probing(cells: dict[int, Cells]):
    """Each query with the cells that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probed: list[list[int]] = [[0]] * batch.num_rows
            for dim, at, units in _by_length(batch):
                if dim in cells:
                    for i, near in zip(at.tolist(), cells[dim].nearest(units, cells[dim].probes).tolist(), strict=True):
                        probed[i] = near
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "v", "dim")), pa.array(probed, pa.list_(pa.int64()))], names=["vec_id", "v", "dim", "cells"])

    return run


def _fit_part(k: int, cell_rows: int):
    """Centroids of the parts of one overfull cell, from its sample."""

    def run(sample: pa.Table) -> pa.Table:
        scaled, norm = _units(sample["v"])
        count = min(PARTS, -(-sample["held"][0].as_py() // cell_rows), len(sample) // SAMPLE_PER_CELL)
        parts = fit_cells(scaled / np.sqrt(norm)[:, None], count, k)
        return pa.table({"dim": sample["dim"].slice(0, 1), "cell": sample["cell"].slice(0, 1), "centroids": pa.array([parts.centroids.astype("<f8").tobytes()], pa.binary()), "probes": pa.array([parts.probes], pa.int32())})

    return run


def _nearest_parts(units: np.ndarray, part: pa.Table, count: int) -> np.ndarray:
    return Cells(np.frombuffer(part["centroids"][0].as_py(), dtype="<f8").reshape(-1, units.shape[1]), 1).nearest(units, count)


def _into_parts(rows: pa.Table, part: pa.Table) -> pa.Table:
    """Vectors of a cell, each in its nearest part."""
    if not rows.num_rows:
        return rows.select(["vec_id", "v", "dim", "cell", "code", "scalar"])
    scaled, norm = _units(rows["v"])
    near = _nearest_parts(scaled / np.sqrt(norm)[:, None], part, 1)[:, 0]
    cell = (rows["cell"].to_numpy() + 1) * 2 * PARTS + near  # beyond all ids of the round before
    return pa.table({c: pa.array(cell) if c == "cell" else rows[c] for c in ("vec_id", "v", "dim", "cell", "code", "scalar")})


def _probing_parts(queries: pa.Table, part: pa.Table) -> pa.Table:
    """Queries that probe a cell, with the parts of it that they probe."""
    if not queries.num_rows:
        return queries.select(["vec_id", "v", "dim", "cell"])
    scaled, norm = _units(queries["v"])
    near = _nearest_parts(scaled / np.sqrt(norm)[:, None], part, part["probes"][0].as_py())
    out = queries.take(pa.array(np.repeat(np.arange(len(near)), near.shape[1])))
    cell = (out["cell"].to_numpy() + 1) * 2 * PARTS + near.ravel()
    return pa.table({c: pa.array(cell) if c == "cell" else out[c] for c in ("vec_id", "v", "dim", "cell")})


def _split(index: DataFrame, probing: DataFrame, k: int, cell_rows: int) -> tuple[DataFrame, DataFrame] | None:
    """index and probing with overfull cells cut into parts; None where no cell is overfull."""
    big = materialize(index.groupBy("dim", "cell").agg(F.count("*").alias("held")).filter(F.col("held") > 2 * cell_rows), "overfull")
    if big.isEmpty():
        return None
    most = F.least(F.lit(SAMPLE_ROWS), F.greatest(F.lit(256), F.floor(F.lit(SAMPLE_BYTES) / (8 * F.col("dim")))), F.greatest(F.lit(256), F.ceil(F.col("held") / cell_rows) * SAMPLE_PER_CELL))
    share = F.pmod(F.xxhash64("vec_id", "cell", F.lit(6)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = index.join(big, ["dim", "cell"]).filter(share < most / F.col("held")).select("dim", "cell", "held", "v")
    parts = materialize(sample.groupBy("dim", "cell").applyInArrow(_fit_part(k, cell_rows), "dim long, cell long, centroids binary, probes int"), "parts")

    def dealt(df: DataFrame, tile_rows: int):
        """Rows of overfull cells in tiles, and the parts of its cell for each tile."""
        tiles = materialize(df.join(parts.select("dim", "cell"), ["dim", "cell"]).groupBy("dim", "cell").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("tiles")), "tiles")
        rows = df.join(tiles, ["dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int")).drop("tiles")
        each = parts.join(tiles, ["dim", "cell"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
        return rows.groupBy("dim", "cell", "tile").cogroup(each.groupBy("dim", "cell", "tile"))

    rest = lambda df: df.join(parts.select("dim", "cell"), ["dim", "cell"], "left_anti")
    rows = dealt(index, TILE_ROWS).applyInArrow(lambda a, b: _into_parts(a, b), index.schema)
    asks = dealt(probing, TILE_QUERIES).applyInArrow(lambda a, b: _probing_parts(a, b), probing.schema)
    return materialize(rest(index).select(*index.columns).unionByName(rows), "index"), materialize(rest(probing).select(*probing.columns).unionByName(asks), "probing")


# --------------------------------------------------------------------------- tiles

_SCORES = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _tile(k: int, epsilon: float):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _SCORES.empty_table()
        q, q_norm = _units(queries["v"])
        x, x_norm = _units(rows["v"])
        q_id, x_id = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        length = length_of(x.shape[1])
        words = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint64).reshape(len(x), length // 64)
        codes, ones, scalars = np.ascontiguousarray(words.T), np.bitwise_count(words).sum(axis=1, dtype=np.int64), rows["scalar"].to_numpy()
        turned = (q / np.sqrt(q_norm)[:, None]) @ rotation(x.shape[1], length).T
        out = []
        for i in range(len(q)):
            guess, spread = estimate(turned[i], codes, ones, scalars)
            width = epsilon * spread + 1e-9
            low = guess - width
            least = np.partition(low, -k)[-k] if len(x) > k else -np.inf
            near = np.flatnonzero(guess + width >= least)
            scores = np.clip(_dot(np.broadcast_to(q[i], (len(near), q.shape[1])), x[near]) / np.sqrt(q_norm[i] * x_norm[near]), -1, 1)
            best = np.lexsort((x_id[near], -scores))[:k]
            out.append(pa.table([np.full(len(best), q_id[i]), x_id[near[best]], scores[best]], schema=_SCORES))
        return pa.concat_tables(out)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, epsilon: float = EPSILON, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k rows of `vectors` nearest to each row of `queries` by cosine, the query's own id excepted.

    Both have vec_id and embedding. Returns query_id, rank (from 1), vec_id, score (cosine in double precision); nearest
    first, ties to the smaller vec_id. Vectors that are null, empty or zero, or hold null or non-finite components, and
    rows without an id take no part; rows that repeat count once; vectors of another length are never neighbours. Equal
    vectors are compared once: of a group only the k+1 smallest ids can be among the nearest. An empty table gives an
    empty result; other columns are not looked at.

    Every vector is indexed. Cells, and the parts of overfull ones, are fitted on at most SAMPLE_ROWS vectors each; up to `cell_rows` vectors are one cell, where
    the search misses only what the error bound misses.
    """
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v").cast("long"))
    # Unit and query vectors as they are; equal ones meet in a window whose limit Spark applies before the shuffle.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    rows = materialize(clean(vectors).distinct().withColumn("r", rank).filter(F.col("r") <= k + 1).drop("r"), "vectors")
    asked = materialize(clean(queries).distinct(), "queries")
    firsts = asked.withColumn("r", rank).filter("r = 1").drop("r")
    cells = _fitted(rows, k, cell_rows)
    index = materialize(rows.mapInArrow(_coded(cells), "vec_id long, v array<double>, dim long, cell long, code binary, scalar double"), "index")
    probing = firsts.mapInArrow(_probing(cells), "vec_id long, v array<double>, dim long, cells array<long>")
    probing = materialize(probing.select("vec_id", "v", "dim", F.explode("cells").alias("cell")), "probing")
    for _ in range(SPLITS):
        again = _split(index, probing, k, cell_rows)
        if again is None:
            break
        index, probing = again
    # How many tiles of rows and of queries a cell has.
    tiles = lambda df, rows, name: df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    sizes = materialize(tiles(index, TILE_ROWS, "row_tiles").join(tiles(probing, TILE_QUERIES, "query_tiles"), ["dim", "cell"]), "sizes")
    dealt = lambda df, own, n, other, m: df.join(sizes, ["dim", "cell"]).withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
    left = dealt(probing, "qt", "query_tiles", "rt", "row_tiles").select("dim", "cell", "qt", "rt", "vec_id", "v").groupBy("dim", "cell", "qt", "rt")
    right = dealt(index, "rt", "row_tiles", "qt", "query_tiles").select("dim", "cell", "qt", "rt", "vec_id", "v", "code", "scalar").groupBy("dim", "cell", "qt", "rt")
    found = left.cogroup(right).applyInArrow(_tile(k + 1, epsilon), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = materialize(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), "found")
    same = materialize(asked.join(firsts.select(F.col("vec_id").alias("query"), "v"), "v").select(F.col("vec_id").alias("query_id"), "query"), "same")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        same.join(found, "query")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
