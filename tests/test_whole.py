"""Whole-table queries, which have no SQL, against brute force over every row."""

import math

import pytest

from terrane.plans import queries as place
from terrane.plans.views import SILVER, frame

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pending(spark):
    """Every pending row by id."""
    return {r.id: r for r in frame(spark, FOLDER, SILVER).filter("merge_status = 'pending'").collect()}


def linked(rows):
    """Pairs a < b at most 55 Web Mercator metres apart."""
    xy = {i: (6378137.0 * math.radians(r.lng), 6378137.0 * math.log(math.tan(math.pi / 4 + math.radians(r.lat) / 2))) for i, r in rows.items()}
    return [(i, j) for i in xy for j in xy if i < j and math.dist(xy[i], xy[j]) <= 55]


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


def test_pairs_of_all_pending_rows(spark, pending):
    got = {(r.a_id, r.b_id): r for r in place.QUERIES["pair_decision_all"](spark, FOLDER).collect()}
    label = components_of(pending, linked(pending))
    groups = {}
    for i, c in label.items():
        groups.setdefault(c, []).append(i)
    assert set(got) == {(i, j) for g in groups.values() for i in g for j in g if i < j} and len(got) > 5000
    assert any(a % 5 == 0 or b % 5 == 0 for a, b in got)

    def equal(a, b):
        return 0.5 if not a or not b else float(a == b)

    for (i, j), r in got.items():
        a, b = pending[i], pending[j]
        assert (r.phone, r.website, r.brand) == (equal(a.phone_e164, b.phone_e164), equal(a.website_domain, b.website_domain), equal(a.brand, b.brand))
        assert r.address == equal(a.address_normalized, b.address_normalized)
        if a.name_original and b.name_original:
            assert 0.5 < r.name <= 1
        assert r.score == pytest.approx(0.4 * r.name + 0.25 * r.address + 0.15 * r.phone + 0.1 * r.website + 0.1 * r.brand, abs=6e-5)
        assert r.decision == ("auto_merge" if r.score >= 0.85 else "needs_llm" if r.score >= 0.65 else "distinct")
    assert {r.decision for r in got.values()} == {"auto_merge", "needs_llm", "distinct"}
    masters = place.QUERIES["dedupe_pass"](spark, FOLDER).collect()
    merged = components_of(pending, [k for k, r in got.items() if r.decision == "auto_merge"])
    sizes = sorted(list(merged.values()).count(c) for c in set(merged.values()))
    assert sorted(r.sources_count for r in masters) == sizes and max(sizes) > 1


def test_clusters_hold_a_long_chain_and_small_places(pending):
    """What the oracle meets at this size: clusters of several sizes, one of them a chain that no point spans."""
    label = components_of(pending, linked(pending))
    sizes = {c: list(label.values()).count(c) for c in set(label.values())}
    assert max(sizes.values()) > 100 and len(set(sizes.values())) > 3
