"""Similarity of two places: parts, composite score and decision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

# Weights of the composite, thresholds of the decision.
WEIGHTS = (("name", 0.40), ("address", 0.25), ("phone", 0.15), ("website", 0.10), ("brand", 0.10))
AUTO_MERGE, NEEDS_LLM, NEUTRAL, LLM_ACCEPT = 0.85, 0.65, 0.5, 0.6
EMBEDDING_DIM = 384


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, from 0 to 1; 0.5 where one is missing, empty or of another length."""
    dot = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot))).otherwise(NEUTRAL)


@pandas_udf(DoubleType())
def _cosine_batches(a: pd.Series, b: pd.Series) -> pd.Series:
    width = lambda v: 0 if v is None else len(v)
    of_a, of_b = (np.fromiter(map(width, s), dtype=np.int64, count=len(s)) for s in (a, b))
    out = np.full(len(a), NEUTRAL)
    for n in np.unique(of_a[(of_a == of_b) & (of_a > 0)]):
        rows = np.flatnonzero((of_a == n) & (of_b == n))
        left, right = (np.stack(s.to_numpy()[rows]).astype(np.float64) for s in (a, b))
        dots = np.einsum("ij,ij->i", left, right)
        out[rows] = np.where(np.isnan(dots), NEUTRAL, np.clip(dots, 0.0, 1.0))
    return pd.Series(out)


def cosine_batches(a: Column, b: Column) -> Column:
    """The same as cosine, as one product for each Arrow batch; a vector that holds nulls counts as missing."""
    return _cosine_batches(a, b)


def equal_or_neutral(a: Column, b: Column) -> Column:
    """1 if equal, 0 if different, 0.5 if one is missing or empty."""
    missing = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(missing, NEUTRAL).when(a == b, 1.0).otherwise(0.0)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with bits for the rows of the table."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        u = state & masks.get(ch, 0)
        state = (state + u | state - u) & full
    return len(a) - state.bit_count()


def _ratio(a: str, b: str) -> float:
    """Percentage by insertions and deletions."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _common(a, b) / total


def token_set_ratio_text(a: str, b: str) -> float:
    """Token-set ratio in percent: words shared against each side's words."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (left & right, left - right, right - left))
    if both and (not only_a or not only_b):
        return 100.0
    best = _ratio(only_a if not both else f"{both} {only_a}", only_b if not both else f"{both} {only_b}")
    if both:
        best = max(best, _ratio(both, f"{both} {only_a}"), _ratio(both, f"{both} {only_b}"))
    return best


@pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
    ratio = {p: token_set_ratio_text(*p) / 100 if all(p) else NEUTRAL for p in set(pairs)}
    return pd.Series([ratio[p] for p in pairs], dtype="float64")


def token_set_ratio(a: Column, b: Column) -> Column:
    """Token-set similarity from 0 to 1; 0.5 where one side is empty. Arrow batches, each different pair of a batch once."""
    return _token_set(a, b)


@pandas_udf(ArrayType(FloatType()))
def _embed(names: pd.Series) -> pd.Series:
    texts = [f" {name.strip().lower()} " if name.strip() else "" for name in names.fillna("")]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    sums = np.zeros(len(texts) * EMBEDDING_DIM)
    for n in (2, 3, 4):
        inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        h = np.full(len(inside), 1469598103934665603, dtype=np.uint64)
        for k in range(n):
            h = (h ^ points[inside + k]) * np.uint64(1099511628211)
        sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        at = owner[inside] * EMBEDDING_DIM + (h % np.uint64(EMBEDDING_DIM)).astype(np.int64)
        sums += np.bincount(at, weights=sign, minlength=len(sums))
    vectors = sums.reshape(len(texts), EMBEDDING_DIM)
    norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return pd.Series(list((vectors / np.where(norm > 0, norm, 1.0)).astype(np.float32)))


_EMBEDDER = _embed


def set_embedder(udf) -> None:
    """Put another encoder of names in place: a function of one column to array<float>, unit length, zero for blanks."""
    global _EMBEDDER
    _EMBEDDER = udf


def embed(name: Column) -> Column:
    """Vector of a name; without a model, signed hashed character n-grams of unit length."""
    return _EMBEDDER(name)


def composite(parts: dict[str, Column]) -> Column:
    """Weighted sum of the five parts, to four places."""
    return F.round(sum((parts[k] * w for k, w in WEIGHTS), F.lit(0.0)), 4)


def decision(score: Column, auto: float = AUTO_MERGE, ask: float = NEEDS_LLM) -> Column:
    return F.when(score >= auto, "auto_merge").when(score >= ask, "needs_llm").otherwise("distinct")
