"""Components of graphs of every shape, and how many rounds they take."""

import random

import pytest

from terrane.operators import components
from terrane.operators.components import connected_components, thinned


def plain(edges):
    label = {}
    for a, b in edges:
        if a is not None and b is not None:
            label.setdefault(a, a)
            label.setdefault(b, b)

    def top(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            label[max(a, b)] = min(a, b)
    return {x: top(x) for x in label}


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(600)],
        [(i + 1, i) for i in range(0, 900, 3)] + [(7, 7), (7, 7), (5, None), (None, None)],
        [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(1001, 1300)] + [(399, 1000)],
        [(random.Random(i).randrange(500), random.Random(-i).randrange(500)) for i in range(300)],
        [],
    ],
)
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain(edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of rising ids shrinks by a factor in each round."""
    written = []
    real = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, name: written.append(name) or real(df, name))
    n = 20_000
    got = connected_components(spark.range(n).selectExpr("id AS a", "id + 1 AS b"))
    assert got.count() == n + 1 and got.filter("component <> 0").count() == 0
    assert 1 < written.count("tops") <= 14


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_thinned_edges_have_the_same_components(spark, monkeypatch, most):
    """All pairs of groups of 60, and a chain: components as before, from few edges."""
    monkeypatch.setattr(components, "EDGES", most)
    edges = [(100 * g + i, 100 * g + j) for g in range(5) for i in range(60) for j in range(i + 1, 60)] + [(5000 + i, 5001 + i) for i in range(300)]
    random.Random(4).shuffle(edges)
    few = [(r.a, r.b) for r in thinned(spark.createDataFrame(edges, "a long, b long").coalesce(2)).collect()]
    assert plain(few) == plain(edges) and (most == 40 or len(few) <= 2 * (5 * 59 + 300))
    assert thinned(spark.createDataFrame([], "a long, b long")).count() == 0
