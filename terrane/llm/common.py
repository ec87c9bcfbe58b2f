"""Shared helpers: scratch tables, document columns and vectorised word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.plans.scratch import checkpoint_dir, materialize

__all__ = ["as_bytes", "checkpoint_dir", "chunks", "lower_ascii", "materialize", "mix64", "signed", "sorted_side", "table", "unused", "word_hashes"]

#: Text is worked on in numpy in chunks of about so many bytes (one longer text is a chunk of its own).
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_side(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: met by sorting at every size, never broadcast, so the plan of a small table
    is the plan of a large one."""
    return df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. All-ASCII texts take the fast built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


# --------------------------------------------------------------------------- words and hashes in numpy

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as long as the longest chunk so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            step = np.full(size, _BASE, dtype=np.uint64)
            step[0] = 1
            back = np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64)
            back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up, self.down


_POWERS = _Powers()


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of a few texts at once.

    Returns (hash uint64, text index, byte start, byte end in the joined buffer, the joined buffer).
    """
    buffer = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    space = _SPACE[buffer]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    up, down = _POWERS.upto(len(buffer) + 1)
    values = _BYTE[buffer]
    values *= up[: len(buffer)]
    sums = np.empty(len(buffer) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    firsts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, dtype=np.int64)
    owner = np.searchsorted(firsts, starts, side="right") - 1
    return hashes, owner, starts, ends, buffer


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES, most: int = CHUNK_TEXTS):
    """(first, last) index ranges of about `limit` bytes and at most `most` texts each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > limit or i - first >= most):
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as int64 of the same bits, for Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
