"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.plans.scratch import discard_since, mark, materialize

#: Pointer jumps in a round: steps that a label travels further along a chain before the edges are contracted.
JUMPS = 2
#: Edges that a task thins at a time.
EDGES = 1 << 20


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable), for every node that an edge names.

    Nodes are numbered in the order of their hashes first: hooked in the order of ids, a chain of rising ids would shrink by a few
    nodes a round. Each round then hooks every node to its smallest neighbour, follows these pointers a few times and contracts the
    edges, so the edge table shrinks by a factor until it is empty, whatever the graph. No step gathers a node's neighbours: hubs are
    met by partial minima and by joins that adaptive execution can split. Loops and repeated edges do no harm.
    """
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    since = mark()
    pairs = materialize(pairs, "edges")
    names = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().sortWithinPartitions(F.xxhash64("node")).withColumn("k", F.monotonically_increasing_id()), "names")
    named = lambda c: names.select(F.col("node").alias(c), F.col("k").alias(f"k{c}"))
    pairs = pairs.filter("a < b").join(named("a"), "a").join(named("b"), "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    kept = pairs = materialize(pairs, "edges")
    tops: list[DataFrame] = []
    while not pairs.isEmpty():
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p"))
        above, jumped = parent.select(F.col("node").alias("p"), F.col("p").alias("pp")), parent
        for _ in range(JUMPS):
            jumped = jumped.join(above, "p").select("node", F.col("pp").alias("p"))
        parent = materialize(jumped, "tops")
        tops.append(parent)
        at_a, at_b = parent.select(F.col("node").alias("a"), F.col("p").alias("pa")), parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        kept = pairs = materialize(pairs.join(at_a, "a").join(at_b, "b").filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard_since(edges.sparkSession, since, names, kept, *tops)
    # From the last round back, so what is joined grows from the few nodes left to all of them.
    top = names.select(F.col("k").alias("node"), F.col("k").alias("p")).limit(0)
    for step in reversed(tops):
        after = top.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        top = step.join(after, "p", "left").select("node", F.coalesce("pp", "p").alias("p"))
    found = materialize(names.join(top.select(F.col("node").alias("k"), "p"), "k", "left").select("node", F.coalesce("p", "k").alias("at")), "found")
    discard_since(edges.sparkSession, since, found)
    return found.join(found.groupBy("at").agg(F.min("node").alias("component")), "at").select("node", "component")


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component, with that smallest one."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[x], top[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := top[top], top):
            top = above
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[top[below]], nodes[below]


def thinned(edges: DataFrame) -> DataFrame:
    """a, b: fewer edges (of longs, none null) with the same nodes and components. Each task puts out a star for each component that its
    edges have, so where edges are many and nodes few, little is shuffled. Loops go: a node that only loops name is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        most = EDGES

        def put(rows: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for first in range(0, len(rows[0]), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(r[first : first + 65536]) for r in rows], names=["a", "b"])

        together = lambda: tuple(np.concatenate([h[i] for h in held]) for i in (0, 1))
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            if sum(len(a) for a, _ in held) >= most:
                rows = _star(*together())
                if 2 * len(rows[0]) > most:  # thin already: more of the same would be looked at again and again
                    yield from put(rows)
                    held = []
                else:
                    held = [rows]
        if held:
            yield from put(_star(*together()))

    return edges.select(*[edges[c].cast("long").alias(c) for c in ("a", "b")]).mapInArrow(run, "a long, b long")
