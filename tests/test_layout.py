"""Spatial layout, versions, the archive by month, and trees of units."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators.hierarchy import import_units, resolve_parents
from terrane.sources.layout import BITS, files_of_box, read_box, read_radius, write_layout, z_ranges, z_value
from terrane.sources.tables import archive_months, read_version, write_version


def test_z_values_and_ranges(spark):
    rng = np.random.default_rng(1)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    got = [r.z for r in spark.createDataFrame(points, "lat double, lng double").coalesce(1).select(z_value(F.col("lat"), F.col("lng")).alias("z")).collect()]
    for (lat, lng), z in zip(points, got, strict=True):
        x, y = min(int((lng + 180) / 360 * 2**BITS), 2**BITS - 1), min(int((lat + 90) / 180 * 2**BITS), 2**BITS - 1)
        assert z == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(BITS))
    for _ in range(40):
        (a, b), (c, d) = sorted(rng.uniform(-180, 180, 2)), sorted(rng.uniform(-90, 90, 2))
        for most in (1, 8, 64):
            ranges = z_ranges(a, c, b, d, most)
            assert len(ranges) <= most + 3 and all(x[1] + 1 < y[0] for x, y in zip(ranges, ranges[1:], strict=False))
            assert all(any(lo <= z <= hi for lo, hi in ranges) for (lat, lng), z in zip(points, got, strict=True) if a <= lng <= b and c <= lat <= d)


def test_a_box_reads_few_files(spark, tmp_path):
    n = 60_000
    rows = spark.range(n).select("id", (F.lit(8.0) + F.rand(1) * 15).alias("lat"), (F.lit(102.0) + F.rand(2) * 7).alias("lng"), F.lit("x").alias("z"))
    rows = rows.unionByName(spark.range(5).select((F.col("id") + n).alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(105.0).alias("lng"), F.lit("x").alias("z")))
    rows.write.parquet(f"{tmp_path}/plain")
    rows = spark.read.parquet(f"{tmp_path}/plain")
    write_layout(rows, f"{tmp_path}/laid", 64)
    assert spark.read.parquet(f"{tmp_path}/laid/files").agg(F.sum("rows"), F.count("*")).first() == (n + 5, 64)
    for west, south, east, north in ((105.0, 21.0, 105.1, 21.1), (102.0, 8.0, 109.0, 23.0), (106.5, 10.5, 107.5, 11.0), (0.0, 0.0, 1.0, 1.0)):
        want = {r.id for r in rows.filter(geo.in_bbox(F.col("lat"), F.col("lng"), west, south, east, north)).collect()}
        got = read_box(spark, f"{tmp_path}/laid", west, south, east, north)
        assert {r.id for r in got.collect()} == want and got.columns == rows.columns
    near = {r.id for r in rows.filter(geo.within_radius(F.col("lat"), F.col("lng"), 21.03, 105.85, 20_000)).collect()}
    assert near and {r.id for r in read_radius(spark, f"{tmp_path}/laid", 21.03, 105.85, 20_000).collect()} == near
    # Five kilometres around a point: a twentieth of the files at most.
    assert files_of_box(spark, f"{tmp_path}/laid", 105.80, 20.98, 105.90, 21.08).count() <= 3


def test_writers_never_share_a_version(spark, tmp_path):
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: (write_version(spark.range(k + 1), f"{tmp_path}/t"), k), range(6)))
    assert sorted(v for v, _ in got) == [1, 2, 3, 4, 5, 6]
    assert all(read_version(spark, f"{tmp_path}/t", v).count() == k + 1 for v, k in got)


def test_archive_by_month_moves_nothing_twice(spark, tmp_path):
    day = lambda y, m, d: dt.datetime(y, m, d)
    rows = [(1, day(2022, 1, 5), "a"), (2, day(2022, 1, 20), "b"), (3, day(2022, 2, 3), "c"), (4, day(2023, 6, 1), "d"), (5, None, "e")]
    raw = spark.createDataFrame(rows, "id long, fetched_at timestamp, payload string")
    path, at = f"{tmp_path}/archive", lambda d: F.lit(d).cast("timestamp")
    held = lambda: {(r.id, r.month, r.payload) for r in spark.read.parquet(path).collect()}
    kept = archive_months(raw, path, at("2023-01-10 00:00:00"))
    assert {r.id for r in kept.collect()} == {2, 3, 4, 5} and held() == {(1, "2022-01", "a")}
    # The same run again, then a later one over rows of which some are moved already: January is whole, February comes in.
    archive_months(raw, path, at("2023-01-10 00:00:00"))
    assert held() == {(1, "2022-01", "a")}
    kept = archive_months(raw, path, at("2023-03-01 00:00:00"))
    assert {r.id for r in kept.collect()} == {4, 5} and held() == {(1, "2022-01", "a"), (2, "2022-01", "b"), (3, "2022-02", "c")}
    assert spark.read.parquet(path).count() == 3
    kept = archive_months(kept, path, at("2023-03-01 00:00:00"))
    assert kept.count() == 2 and spark.read.parquet(path).count() == 3


def plain_tree(units):
    parent, out = dict(units), {}
    for code in parent:
        at, depth, seen, problem = code, 0, {code}, None
        while parent[at]:
            if parent[at] not in parent:
                problem = "orphan"
                break
            at, depth = parent[at], depth + 1
            if at in seen:
                problem = "cycle"
                break
            seen.add(at)
        out[code] = (None, None, problem) if problem else (at, depth, None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_parents_of_any_depth(spark, seed):
    rng = random.Random(seed)
    units = [(f"u{i}", rng.choice([None, "", "gone", *[f"u{rng.randrange(80)}" for _ in range(12)]])) for i in range(80)] + [(f"c{i}", f"c{i - 1}" if i else None) for i in range(70)] + [("self", "self"), ("x", "y"), ("y", "z"), ("z", "x"), ("below", "y")]
    got = {r.code: (r.root, r.depth, r.problem) for r in resolve_parents(spark.createDataFrame(units, "code string, parent_code string")).collect()}
    assert got == plain_tree(units)
    assert resolve_parents(spark.createDataFrame([], "code string, parent_code string")).count() == 0


def test_import_keeps_what_is_there(spark):
    unit = "code string, name string, parent_code string, level int, lng_min double, lat_min double, lng_max double, lat_max double"
    current = spark.createDataFrame([("01", "Hà Nội", None, 1, 105.0, 20.0, 106.0, 21.0), ("01.001", "Ba Đình", "01", 2, 105.0, 20.0, 105.5, 20.5), ("02", "Hà Giang", None, 1, 104.0, 22.0, 105.0, 23.0), ("03", "Cao Bằng", None, 1, 105.0, 22.0, 106.0, 23.0)], unit)
    box = (105.1, 20.1, 105.2, 20.2)
    incoming = spark.createDataFrame(
        [("01.002", "Hoàn Kiếm", "01", 2, *box), ("02.026", "Đồng Văn", "02", 2, *box), ("02.026", "Đồng Văn b", "02", 2, *box), ("02.027", "", "02", 2, *box), ("02.028", "No box", "02", 2, None, None, None, None), ("02.026.1", "Lũng Cú", "02.026", 3, *box), ("99.001", "Lost", "99", 2, *box), ("99.001.1", "Lost too", "99.001", 3, *box), ("a", "A", "b", 2, *box), ("b", "B", "a", 2, *box), ("03", "Cao Bằng (new)", None, 1, 105.5, 22.5, 106.5, 23.5)],
        unit,
    )
    units, report = import_units(current, incoming)
    assert {r.code: r.outcome for r in report.collect()} == {"01.002": "skipped", "02.026": "inserted", "02.027": "missed", "02.028": "missed", "02.026.1": "inserted", "99.001": "orphan", "99.001.1": "orphan", "a": "cycle", "b": "cycle", "03": "updated"}
    got = {r.code: r for r in units.collect()}
    assert set(got) == {"01", "01.001", "02", "03", "02.026", "02.026.1"} and got["03"].name == "Cao Bằng (new)" and got["03"].lng_min == 105.5 and got["01.001"].name == "Ba Đình" and got["02.026"].name == "Đồng Văn"
    again, report = import_units(units, incoming)
    assert {r.outcome for r in report.filter("code LIKE '02%'").collect()} == {"skipped"} and again.count() == 6
    assert "01.002" in {r.code for r in import_units(current, incoming, skip_existing=False)[0].collect()}
