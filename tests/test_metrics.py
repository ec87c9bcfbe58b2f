"""Counters, histograms, jobs, clusters of ids and keys on small tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import text
from terrane.operators import dedupe, jobs, metrics, normalize, serve

START = dt.datetime(2024, 1, 1)
SAMPLES = "name string, ts timestamp, value double"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_increase_counts_resets_and_borders(spark):
    rows = [("a", at(0), 5.0), ("a", at(200), 9.0), ("a", at(310), 10.0), ("a", at(320), 2.0), ("a", at(900), 3.0), ("b", at(10), 7.0), ("b", at(20), None), ("b", None, 9.0)]
    got = {(r.name, r.window_start): (r.increase, r.rate) for r in metrics.increases(spark.createDataFrame(rows, SAMPLES), ("name",)).collect()}
    assert got == {("a", at(0)): (4.0, 4 / 300), ("a", at(300)): (3.0, 3 / 300), ("a", at(900)): (1.0, 1 / 300), ("b", at(0)): (0.0, 0.0)}
    assert metrics.increases(spark.createDataFrame([], SAMPLES), ("name",)).count() == 0


def test_increase_equals_a_loop(spark):
    random.seed(5)
    rows = [(random.choice("xxxxy"), at(random.randrange(5000)), float(random.randrange(50))) for _ in range(400)]
    want, last = {}, {}
    for name, ts, value in sorted(rows):
        key = (name, at((ts - START).total_seconds() // 300 * 300))
        before = last.get(name)
        want[key] = want.get(key, 0.0) + (0.0 if before is None else value if value < before else value - before)
        last[name] = value
    got = {(r.name, r.window_start): r.increase for r in metrics.increases(spark.createDataFrame(rows, SAMPLES), ("name",)).collect()}
    assert got == pytest.approx(want)


def test_histogram_quantiles(spark):
    inf = math.inf
    rows = [("a", 1.0, 10), ("a", 2.0, 30), ("a", inf, 40), ("none", 1.0, 0), ("none", inf, 0), ("open", 1.0, 3), ("split", 4.0, 1), ("split", 4.0, 1), ("split", inf, 2)]
    made = spark.createDataFrame(rows, "name string, le double, count long")
    got = {r.name: (r.low, r.mid, r.high) for r in metrics.histogram_quantiles(made, ("name",), {"low": 0.125, "mid": 0.5, "high": 0.95}).collect()}
    assert got == {"a": (0.5, 1.5, 2.0), "none": (None, None, None), "open": (None, None, None), "split": (0.5, 2.0, pytest.approx(3.8))}


def test_jobs(spark):
    sources = spark.createDataFrame([(1, "one")], "id int, code string")
    asked = spark.createDataFrame(
        [(1, "one", "area_sweep", 1.0, 2.0, 3.0, None, None), (2, "two", "area_sweep", 1.0, 2.0, 3.0, None, None), (3, "one", "backfill", None, None, None, None, None), (4, "one", "detail_enrich", None, None, None, None, "x")],
        "id long, source_code string, job_type string, lat double, lng double, radius_m double, category string, source_poi_id string",
    )
    now = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    made = jobs.create_jobs(asked, sources, now)
    got = {r.id: (r.status, r.error, r.params) for r in made.collect()}
    assert got[1] == ("pending", None, '{"lat":1.0,"lng":2.0,"radius_m":3.0}')
    assert got[2][:2] == (None, "unknown source") and got[3][:2] == (None, "backfill is not supported") and got[4][:2] == ("pending", None)
    kept = made.filter("error IS NULL")
    assert jobs.count_jobs(kept, sources, "one", "pending").first().total == 2 and jobs.count_jobs(kept, sources, "two").first().total == 0
    started = {r.id: (r.status, r.started_at) for r in jobs.start_jobs(kept, now, spark.createDataFrame([(4,), (4,), (9,)], "id long")).collect()}
    assert started == {1: ("pending", None), 4: ("running", START)}
    assert jobs.get_job(kept, 4).count() == 1 and jobs.get_job(kept, 3).count() == 0


def test_clusters_of_ids_override_the_status(spark):
    rows = [(1, 10.0, 100.0, "pending"), (2, 10.0, 100.0, "merged"), (3, 10.0, 100.0, "pending"), (4, 12.0, 100.0, "merged")]
    silver = spark.createDataFrame(rows, "id long, lat double, lng double, merge_status string")
    of = lambda **k: {r.id: r.cluster_id for r in dedupe.cluster(silver, **k).collect()}
    assert of() == {1: 1, 3: 1} and of(only_pending=False) == {1: 1, 2: 1, 3: 1, 4: 4}
    assert of(ids=spark.createDataFrame([(2,), (3,), (3,), (4,)], "id long")) == {2: 2, 3: 2, 4: 4}
    assert of(ids=spark.createDataFrame([], "id long")) == {}


def test_backfill_leaves_known_provinces(spark):
    rows = [(1, 1.0, 1.0, None, None, None), (2, 1.0, 1.0, "99", "99.001", None), (3, 50.0, 1.0, None, None, None)]
    silver = spark.createDataFrame(rows, "id long, lat double, lng double, province_code string, district_code string, ward_code string")
    units = spark.createDataFrame([("10", 1, 0.0, 0.0, 2.0, 2.0), ("10.001", 2, 0.0, 0.0, 2.0, 2.0)], "code string, level int, lng_min double, lat_min double, lng_max double, lat_max double")
    got = {r.id: (r.province_code, r.district_code) for r in normalize.backfill_admin(silver, units).collect()}
    assert got == {1: ("10", "10.001"), 2: ("99", "99.001"), 3: (None, None)}


def test_keys_and_access(spark):
    keys = spark.createDataFrame([("pl_a", "pl_a", ["read"]), ("pl_a", "pl_b", ["*"]), ("a", "a", ["*"]), (None, "pl_a", ["*"]), ("pl_c", "pl_c", ["*"]), ("pl_d", "pl_d", None)], "given string, kept string, held array<string>")
    valid = text.api_key_valid(F.col("given"), text.api_key_hash(F.col("kept")))
    got = keys.select(valid.alias("v"), serve.access(valid, F.col("held"), "write").alias("s")).collect()
    assert [(r.v, r.s) for r in got] == [(True, 403), (False, 401), (False, 401), (False, 401), (True, 200), (True, 403)]
