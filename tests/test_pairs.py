"""Pairs by shared values, twins, and links of dense cells, against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import similarity as sim
from terrane.operators import dedupe
from terrane.operators.cells import linked_cells
from terrane.operators.components import connected_components
from terrane.operators.pairs import EQUAL, given_pairs, pairs_of, plans, reachable_pairs, score_found, scored_classes, self_score, twins

ROW = "id long, cluster_id long, name_embedding array<float>, address_normalized string, phone_e164 string, website_domain string, brand string, merge_status string"
VALUES = (None, "", "v1", "v2")


def test_plans_are_complete_and_disjoint():
    """Every two sets of fields, and every set of equal ones among them: the bound says whether a plan has them, and one has."""
    weights = [dict(sim.WEIGHTS)[k] for k, _ in EQUAL]
    for least in (0.65, 0.7, 0.85, 0.9, 1.0):
        found = plans(least)
        for left in range(8):
            for right in range(left, 8):
                for equal in range(8):
                    if equal & ~(left & right):
                        continue
                    best = 0.65 + sum(w if equal >> i & 1 else 0.0 if (left & right) >> i & 1 else w / 2 for i, w in enumerate(weights))
                    mine = [p for p in found if p[:2] == (left, right) and p[3] >> equal & 1]
                    assert len(mine) == (round(best, 4) >= least), (least, left, right, equal)
                    assert all(p[2] & ~equal == 0 for p in mine)
    assert all(shared for _, _, shared, _ in plans(0.85))  # sure merges share a phone, a website or a brand


def made(seed, n, clusters=3):
    rng = random.Random(seed)
    names = [[1.0, 0.0], [0.96, 0.28], [0.8, 0.6], [0.0, 1.0]]
    return [
        (i, rng.randrange(clusters), rng.choice([*names, *names, None, []]), rng.choice([None, "", "1 long street", "1 long street east", "9 other road"]), rng.choice(VALUES), rng.choice(VALUES), rng.choice(VALUES), rng.choice(["pending"] * 8 + ["merged"]))
        for i in rng.sample(range(10 * n), n)
    ]


def all_scored(members):
    return {(r.a_id, r.b_id): r for r in dedupe.score_pairs(dedupe.candidate_pairs(members)).collect()}


@pytest.mark.parametrize("least", [sim.NEEDS_LLM, 0.8, sim.AUTO_MERGE, 0.95])
def test_reachable_pairs_equal_all_pairs(spark, least):
    members = spark.createDataFrame(made(int(100 * least), 220), ROW)
    want = {k: (round(r.score, 4), r.decision) for k, r in all_scored(members).items() if r.score >= least}
    pairs = reachable_pairs(members, least).collect()
    assert len(pairs) == len({(r.a_id, r.b_id) for r in pairs}) and want
    got = {(r.a_id, r.b_id): (round(r.score, 4), r.decision) for r in score_found(reachable_pairs(members, least), members, least).collect()}
    assert got == want
    assert reachable_pairs(members.limit(0), least).count() == 0


def test_given_pairs(spark):
    members = spark.createDataFrame(made(5, 60), ROW)
    want = all_scored(members)
    ids = [(b, a) if (a + b) % 2 else (a, b) for a, b in want] + [(10**9, 1), (members.first().id,) * 2]
    got = given_pairs(spark.createDataFrame(ids + ids[:3], "a_id long, b_id long"), members).collect()
    assert {(r.a_id, r.b_id): (r.phone, r.website, r.brand) for r in got} == {k: (r.phone, r.website, r.brand) for k, r in want.items()} and len(got) == len(want)


def components_of(ids, edges):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            least = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = least
    return label


@pytest.mark.parametrize("asked", [False, True])
def test_merging_edges_connect_what_all_pairs_connect(spark, asked):
    """With twins, and with resolutions of pairs that need a model, that don't, and that are of two clusters."""
    rows = made(11, 150)
    rows += [(10_000 + i, *rng[1:]) for i, rng in enumerate(rows[:60])]
    members = spark.createDataFrame(rows, ROW)
    scored = all_scored(members)
    rng, ids = random.Random(3), [r[0] for r in rows]
    said = [(*sorted(rng.sample(ids, 2)), rng.random() < 0.7, rng.choice([0.3, 0.6, 0.9])) for _ in range(4000)]
    said = list({s[:2]: s for s in said}.values())
    resolutions = spark.createDataFrame(said, "lo_id long, hi_id long, same boolean, confidence double") if asked else None
    yes = {s[:2] for s in said if s[2] and s[3] >= 0.6} if asked else set()
    want = [k for k, r in scored.items() if r.decision == "auto_merge" or (r.decision == "needs_llm" and k in yes)]
    got = [(r.a, r.b) for r in dedupe.merging_edges(members, resolutions).collect()]
    assert components_of(ids, got) == components_of(ids, want)
    asks = {(r.a_id, r.b_id) for r in dedupe.pairs_to_ask(members).collect()}
    assert asks == {k for k, r in scored.items() if r.decision == "needs_llm"}


def test_twins_score_alike(spark):
    members = spark.createDataFrame(made(2, 200, 1), ROW)
    of = {r.id: r.twin_of for r in twins(members).collect()}
    rows = {r.id: (tuple(r.name_embedding or ()), *[r[c] or "" for c in ("address_normalized", "phone_e164", "website_domain", "brand")]) for r in members.collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault((rows[i], members.schema.names and (rows[i][0] or None)), i)
    assert all(rows[i] == rows[t] and t <= i for i, t in of.items()) and len(of) == len(rows)
    own = {r.id: r.s for r in members.select("id", self_score().alias("s")).collect()}
    for (a, b), r in all_scored(members).items():
        if of[a] == of[b]:
            assert r.score == pytest.approx(own[a], abs=1e-4)


@pytest.mark.parametrize("alike", [3, 1000])
def test_pairs_of_classes_equal_all_pairs(spark, alike):
    rows = made(13, 90)
    members = spark.createDataFrame(rows + [(100_000 * k + i, *rest) for k in (1, 2, 3) for i, *rest in rows[:40]], ROW)
    want = {k: (r.name, r.address, r.phone, r.website, r.brand, r.score, r.decision) for k, r in all_scored(members).items() if r.score >= sim.NEEDS_LLM}
    classes, of = scored_classes(members, sim.NEEDS_LLM)
    got = pairs_of(classes, of, alike).collect()
    assert {(r.a_id, r.b_id): (r.name, r.address, r.phone, r.website, r.brand, r.score, r.decision) for r in got} == want and len(got) == len(want)
    assert classes.count() < len(want) / 2
    assert pairs_of(*scored_classes(members.limit(0), sim.NEEDS_LLM)).count() == 0


def test_rows_alike_are_scored_once(spark):
    """2,000 rows alike and 1,000 others of their cluster: two classes, three pairs to score, and every pair of rows in the result."""
    row = lambda brand: (0, [1.0, 0.0], "1 street", "p", "w", brand, "pending")
    members = spark.createDataFrame([(i, *row("x" if i % 3 else "y")) for i in range(3000)], ROW)
    classes, of = scored_classes(members, sim.NEEDS_LLM)
    assert sorted((r.a_id, r.b_id, r.decision) for r in classes.collect()) == [(0, 0, "auto_merge"), (0, 1, "auto_merge"), (1, 1, "auto_merge")]
    found = pairs_of(classes, of).select("a_id", "b_id")
    assert found.count() == found.distinct().count() == 3000 * 2999 // 2 and found.filter("a_id >= b_id").count() == 0


def test_no_vectors_are_sent_to_the_driver(spark, tmp_path):
    """Vectors that repeat are small on disk, and Spark guesses their size from that: joins that fetch them don't broadcast."""
    path = str(tmp_path / "members")
    spark.range(20_000).select("id", (F.col("id") / 40).cast("long").alias("cluster_id"), F.transform(F.sequence(F.lit(0), F.lit(383)), lambda k: (k / 1000).cast("float")).alias("name_embedding"), F.lit("1 street").alias("address_normalized"), F.lit("p").alias("phone_e164"), F.lit("w").alias("website_domain"), F.lit("b").alias("brand")).write.parquet(path)
    members = spark.read.parquet(path)
    pairs = spark.range(1, 100).select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"), *[F.lit(1.0).alias(k) for k, _ in EQUAL]).repartition(4)
    found = score_found(pairs, members, sim.NEEDS_LLM)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 4 and "BroadcastExchange" not in plan


def test_a_hot_cluster_is_linear(spark):
    """100,000 places in one cluster, a third of them alike: what is dealt stays in proportion, and few pairs are met."""
    n = 100_000
    i, of = F.col("id"), lambda m, name: F.when(F.col("id") % 3 == 0, F.lit(f"{name}0")).otherwise(F.concat(F.lit(name), F.pmod(F.xxhash64("id", F.lit(name)), F.lit(m))))
    members = spark.range(n).select(i, F.lit(1).cast("long").alias("cluster_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("name_embedding"), F.lit("1 street").alias("address_normalized"), of(20_000, "p").alias("phone_e164"), of(5_000, "w").alias("website_domain"), of(50_000, "b").alias("brand"), F.lit("pending").alias("merge_status"))
    heads = members.join(twins(members).filter("id = twin_of").select("id"), "id")
    assert heads.count() < n * 0.7
    assert reachable_pairs(heads, sim.AUTO_MERGE).count() < 20 * n
    edges = connected_components(dedupe.merging_edges(members))
    assert edges.filter("node % 3 = 0").agg(F.countDistinct("component")).first()[0] == 1


# --------------------------------------------------------------------------- cells


def plain_links(points, eps):
    side = eps / math.sqrt(2)
    cells = {}
    for x, y in points:
        cells.setdefault((math.floor(x / side), math.floor(y / side)), []).append((x, y))
    arrays = {c: np.array(v) for c, v in cells.items()}
    out = set()
    for a, pa in arrays.items():
        for dx in range(-2, 3):
            for dy in range(0, 3):
                b = (a[0] + dx, a[1] + dy)
                if (dy > 0 or dx > 0) and b in arrays:
                    d = (pa[:, None, 0] - arrays[b][None, :, 0]) ** 2 + (pa[:, None, 1] - arrays[b][None, :, 1]) ** 2
                    if (d <= eps * eps).any():
                        out.add((*a, *b))
    return out


def frame_of(spark, points, eps):
    side = eps / math.sqrt(2)
    return spark.createDataFrame([(float(x), float(y)) for x, y in points], "x double, y double").select(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"), "x", "y")


@pytest.mark.parametrize("rounds", [0, 1, 4])
@pytest.mark.parametrize("seed", [1, 2])
def test_linked_cells(spark, seed, rounds):
    rng = np.random.default_rng(seed)
    points = np.concatenate((rng.uniform(-100, 100, (60, 2)), rng.normal(0, 30, (60, 2)), rng.integers(-3, 4, (40, 2)) * 19.445, [[0.0, 0.0], [55.0, 0.0], [0.0, 55.0], [-55.0, 0.0], [0.0, 0.0]]))
    got = [tuple(r) for r in linked_cells(frame_of(spark, points, 55.0), 55.0, rounds).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_links(points, 55.0)
    assert linked_cells(frame_of(spark, points, 55.0).limit(0), 55.0).count() == 0


@pytest.mark.parametrize("gap", [-0.01, 0.01])
def test_two_dense_cells_about_eps_apart(spark, gap):
    """25,000 points on each of two facing arcs whose nearest points are just within eps, or just beyond: no box decides early."""
    eps, n, rng = 55.0, 25_000, np.random.default_rng(8)
    side = eps / math.sqrt(2)
    left = np.stack((rng.uniform(side * 0.55, side * 0.6, n), rng.uniform(0.5, side - 0.5, n)), axis=1)
    right = left.copy()
    right[:, 0] = left[:, 0].max() + eps + gap + (left[:, 0] - left[:, 0].min())
    left, right = np.append(left, [[left[:, 0].max(), side / 2]], axis=0), np.append(right, [[left[:, 0].max() + eps + gap, side / 2]], axis=0)
    points = np.concatenate((left, right))
    assert len({math.floor(x / side) for x in points[:, 0]}) == 2
    found = {tuple(r) for r in linked_cells(frame_of(spark, points, eps), eps).collect()}
    assert bool(found) == (gap < 0) and len(found) <= 1
