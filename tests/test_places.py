"""Normalization, sources, entity resolution, crawl planning: cases with known answers and invariants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import geo, refdata, similarity, text
from terrane.operators import bronze, components, crawl, dedupe, normalize, serve
from terrane.sources import adapters

NOW = dt.datetime(2024, 1, 20, 12)


def one(spark, expression, **values):
    """Value of an expression over one row of inputs."""
    kinds = {str: "string", int: "int", float: "double", list: "array<double>", bool: "boolean"}
    ddl = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("  Cà Phê, Trung  Nguyên! ", "ca phe trung nguyen"), ("Đường_1 A+B/C&D-E", "duong_1 a+b/c&d-e"), ("", ""), (None, ""), ("ÀÁẢ", "aaa"), ("ngã́", "nga")])
def test_normalize_text(spark, given, want):
    assert one(spark, text.normalize_text(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Кафе Пушкинъ", "kafe pushkin"), ("Щёлково, Юность", "shchiolkovo iunost"), ("Київ", "kiyiv"), ("Αθήνα Ψυχή", "athena psukhe"), ("すし トウキョウ", "sushi toukiyou"), ("ラーメン ふじ", "ra-men huzi"), ("Phở 😀 Жук", "pho zhuk"), ("ёЁ Ґ", "ioio g"), ("Ćevapi Њ", "cevapi nj")],
)
def test_normalize_text_of_other_scripts(spark, given, want):
    assert one(spark, text.normalize_text(F.col("t")), t=given) == want


@pytest.mark.parametrize(("url", "want"), [("https://WWW.Example.com:8080/a", "example.com"), ("example.vn/x", "example.vn"), ("www.www.a.vn", "www.a.vn"), ("", None), (None, None)])
def test_extract_domain(spark, url, want):
    assert one(spark, text.extract_domain(F.col("u")), u=url) == want


def test_content_hash_is_canonical(spark):
    a, b, c = '{"b": 1, "a": {"d": [1, 2], "c": "ă"}}', '{"a":{"c":"ă","d":[1,2]},"b":1}', '{"a":{"c":"ă","d":[2,1]},"b":1}'
    hashes = [one(spark, text.content_hash(F.col("p")), p=p) for p in (a, b, c)]
    assert hashes[0] == hashes[1] != hashes[2]


def test_geodesic(spark):
    """Known distances on the ellipsoid: a degree along the equator, a degree along a meridian, Flinders Peak to Buninyong."""
    d = lambda *x: one(spark, geo.geodesic_m(*[F.col(c) for c in "abcd"]), **dict(zip("abcd", map(float, x), strict=True)))
    assert abs(d(0, 0, 0, 1) - 111319.491) < 0.01
    assert abs(d(0, 0, 1, 0) - 110574.389) < 0.01
    assert abs(d(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777) - 54972.271) < 0.01
    assert d(10, 20, 10, 20) == 0


def test_radius_is_inclusive_and_box_is_strict(spark):
    points = spark.createDataFrame([(1, 21.0, 105.0), (2, 21.0, 105.001), (3, 21.1, 105.0)], "id int, lat double, lng double")
    exact = points.filter("id = 2").select(geo.geodesic_m(F.lit(21.0), F.lit(105.0), F.col("lat"), F.col("lng")).alias("d")).first().d
    assert {r.id for r in points.filter(geo.within_radius(F.col("lat"), F.col("lng"), 21.0, 105.0, exact)).collect()} == {1, 2}
    assert {r.id for r in points.filter(geo.in_bbox(F.col("lat"), F.col("lng"), 105.0, 20.0, 106.0, 22.0)).collect()} == {2}


def test_filter_bounds():
    with pytest.raises(ValueError):
        serve.poi_filter(lat=1.0)
    with pytest.raises(ValueError):
        serve.poi_filter(lat=1.0, lng=1.0, radius_m=300_000)


def test_filters_reach_the_scan(spark, capsys):
    from terrane.plans.views import MASTERS, frame

    spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    frame(spark, "/root/testdata/sf0.001", MASTERS).filter(serve.poi_filter(text="bolt")).select("id").explain("formatted")
    shown = capsys.readouterr().out
    assert "ReadSchema" in shown and "p_retailprice" not in shown.split("ReadSchema", 1)[1]


@pytest.mark.parametrize(("box", "size", "low", "high"), [((105.85, 21.025, 105.86, 21.035), 5000.0, 1, 1), ((105.78, 20.95, 105.92, 21.10), 5000.0, 6, 18)])
def test_tiles(spark, box, size, low, high):
    cells = one(spark, geo.tile_centers(*[F.lit(float(x)) for x in box], F.lit(size)), z=1)
    assert low <= len(cells) <= high
    assert all(box[0] < c.lng < box[2] and box[1] < c.lat < box[3] for c in cells)


def test_inverted_box_is_an_error(spark):
    with pytest.raises(Exception, match="inverted"):
        spark.range(1).select(geo.tile_centers(F.lit(2.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(5000.0))).collect()


def test_address_prefixes_that_leave_nothing(spark):
    """'Q.1' is district 1, while 'Q1' leaves nothing and is an unknown part."""
    parsed = [one(spark, normalize.parse_address(F.col("a")), a=a) for a in ("9 A, Q.1", "9 A, Q1", "A, Tỉnh Long An, huyện Bến Lức, xã An Thạnh", ",", "Hà Nội, TP. Huế")]
    assert parsed[0].district == "1" and parsed[1].district is None and parsed[1].ward == "Q1"
    assert (parsed[2].province, parsed[2].district, parsed[2].ward) == ("Long An", "Bến Lức", "An Thạnh")
    assert parsed[3].confidence == 0 and parsed[4].province == "Huế"


def test_brand_rules(spark):
    known = normalize.brand_rows(refdata.brands(spark))
    got = lambda n: one(spark, normalize.detect_brand(F.col("n"), known), n=n)
    assert got("WinMart Cầu Giấy").brand == "WinMart+"  # the earlier pattern takes both
    assert got("a good day").brand is None and got("go shopping").brand == "Big C"
    assert got("Highlands Park").brand == "Highlands Coffee"  # by alias, as its pattern looks ahead


def test_category_pair_is_taken_whole(spark):
    got = one(spark, normalize.category(F.lit("google_places"), F.lit("store"), F.col("n")), n="Bệnh viện X")
    assert (got.category, got.subcategory) == ("retail", None)


def test_quality_of_a_full_row(spark):
    has = {k: F.lit(True) for k in ("name", "address", "phone", "website", "coordinates", "category")}
    q = one(spark, normalize.quality(F.lit("google_places"), F.lit(NOW - dt.timedelta(days=1)), F.lit(NOW), has, F.lit(0.95), F.lit(True)), z=1)
    assert q.score > 0.85 and q.factors.completeness == 1
    old = one(spark, normalize.quality(F.lit("x"), F.lit(NOW - dt.timedelta(days=180)), F.lit(NOW), has, F.lit(7.0), F.lit(False)), z=1)
    assert old.factors.freshness == 0.5 and old.factors.source_reliability == 0.5 and old.factors.address_confidence == 1


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.5), ([], [], 0.5)])
def test_cosine(spark, a, b, want):
    assert one(spark, similarity.cosine(F.col("a"), F.col("b")), a=a, b=b) == want


def test_common_subsequence():
    def slow(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    chance = random.Random(1)
    for _ in range(200):
        a, b = ("".join(chance.choice("abc") for _ in range(chance.randrange(12))) for _ in range(2))
        assert similarity._common(a, b) == slow(a, b)


def test_components_equal_union_find(spark):
    chance = random.Random(7)
    edges = [(chance.randrange(300), chance.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, None)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters(spark):
    points = spark.createDataFrame([(1, 21.0285, 105.8542), (2, 21.02855, 105.85425), (3, 21.02860, 105.85430), (4, 21.0375, 105.8542), (5, None, None)], "id long, lat double, lng double")
    got = {r.id: r.cluster_id for r in dedupe.spatial_clusters(points).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert dedupe.spatial_clusters(points.limit(0)).count() == 0


def test_clusters_equal_all_pairs(spark):
    import math

    chance = random.Random(3)
    rows = [(i, 21 + chance.random() / 200, 105 + chance.random() / 200) for i in range(250)]
    xy = {i: (geo.MERCATOR_R * math.radians(lng), geo.MERCATOR_R * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))) for i, lat, lng in rows}
    label = {i: i for i in xy}
    for _ in range(40):
        for i, a in xy.items():
            for j, b in xy.items():
                if math.dist(a, b) <= 30:
                    label[i] = label[j] = min(label[i], label[j])
    points = spark.createDataFrame(rows, "id long, lat double, lng double")
    assert {r.id: r.cluster_id for r in dedupe.spatial_clusters(points, 30.0).collect()} == label


def silver(spark, rows):
    """Silver rows from (id, source, name, lat, lng, quality, phone, domain, brand)."""
    data = [(i, i + 100, f"s{i}", source, name, "1 Tràng Tiền, Hà Nội", phone, None, domain, "retail", "retail.convenience_stores", brand, lat, lng, quality, "01", None, None, "pending") for i, source, name, lat, lng, quality, phone, domain, brand in rows]
    columns = "id long, raw_poi_id long, source_poi_id string, source_code string, name_original string, address_normalized string, phone_e164 string, website string, website_domain string, openooh_category string, openooh_subcategory string, brand string, lat double, lng double, quality_score double, province_code string, district_code string, ward_code string, merge_status string"
    return spark.createDataFrame(data, columns).withColumn("name_embedding", similarity.embed(F.col("name_original")))


def test_one_place_of_three_sources(spark):
    rows = [
        (1, "google_places", "Circle K — Tràng Tiền", 21.0285, 105.8542, 0.92, "+842438269999", "circlek.vn", "Circle K"),
        (2, "osm_overpass", "Circle K — Tràng Tiền", 21.02851, 105.85421, 0.85, "+842438269999", "circlek.vn", "Circle K"),
        (3, "gosom_scraper", "Circle K — Tràng Tiền", 21.02852, 105.85422, 0.70, "+842438269999", "circlek.vn", "Circle K"),
        (4, "osm_overpass", "Quán Xa", 21.04, 105.8542, 0.5, None, None, None),
    ]
    masters, history, after = dedupe.dedupe(silver(spark, rows), as_of=F.lit(NOW))
    found = {tuple(r.merged_processed_ids): r for r in masters.collect()}
    assert set(found) == {(1, 2, 3), (4,)}
    first = found[(1, 2, 3)]
    assert first.canonical_name == "Circle K — Tràng Tiền" and first.sources_count == 3 and float(first.confidence) == 0.92 and first.province_code == "01"
    assert sorted(r.change_reason for r in history.collect()) == ["initial_merge", "singleton_master"]
    assert {r.merge_status for r in after.collect()} == {"merged"} and after.filter("merged_into IS NULL").count() == 0
    assert sum(len(k) for k in found) == 4


def test_asked_pairs_join_only_when_sure_enough(spark):
    scored = spark.createDataFrame([(1, 2, 0.7, "needs_llm"), (3, 4, 0.7, "needs_llm"), (5, 6, 0.9, "auto_merge"), (7, 8, 0.1, "distinct")], "a_id long, b_id long, score double, decision string")
    calls = []
    said = dedupe.resolve(scored, lambda a, b: (True, 0.9 if a["id"] == 1 else 0.5, "r"))
    edges = {(r.a, r.b) for r in dedupe.accepted_edges(scored, said).collect()}
    assert edges == {(1, 2), (5, 6)} and not calls
    assert {(r.a, r.b) for r in dedupe.accepted_edges(scored).collect()} == {(5, 6)}
    assert dedupe.resolve(scored, lambda a, b: (False, 0.0, ""), said).count() == 2  # all from the cache


def test_resolver_gets_records(spark):
    scored = spark.createDataFrame([(2, 1, 0.7, "needs_llm"), (1, 9, 0.7, "needs_llm")], "a_id long, b_id long, score double, decision string")
    records = silver(spark, [(1, "osm_overpass", "Quán A", 21.0, 105.0, 0.5, None, "a.vn", None), (2, "osm_overpass", "Quán B", 21.0, 105.0, 0.5, "+8490", None, "B")])

    def told(a, b):
        return True, 0.9, f"{a['id']} {a.get('name')} {a.get('website_domain')} {a.get('phone')}; {b['id']} {b.get('name')} {b.get('category')}"

    assert {r.hi_id: r.reason for r in dedupe.resolve(scored, told, records=records).collect()} == {2: "1 Quán A a.vn None; 2 Quán B retail", 9: "1 Quán A a.vn None; 9 None None"}


def test_pairs_of_a_cluster_in_blocks_and_their_bounds(spark):
    """All pairs once, however small the blocks; the bound drops no pair that scores enough, and drops some."""
    chance = random.Random(5)
    pick = lambda *of: chance.choice(of)
    rows = [(i, "osm_overpass", pick("Circle K", "Circle K 2", "", "Quán"), 21.0, 105.0, 0.5, pick(None, "", "+841", "+842"), pick(None, "a.vn", "b.vn"), pick(None, "X", "Y")) for i in range(60)]
    members = silver(spark, rows).withColumn("cluster_id", F.when(F.col("id") < 50, 1).when(F.col("id") < 59, 2))
    members = members.withColumn("address_normalized", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "1 A, B").otherwise("B, 1 A")).withColumn("name_embedding", F.when(F.col("id") % 7 > 0, F.col("name_embedding")))
    pairs = dedupe.candidate_pairs(members, block=4)
    scored = {(r.a_id, r.b_id): r for r in dedupe.score_pairs(pairs).collect()}
    assert sorted(scored) == [(i, j) for i in range(59) for j in range(i + 1, 59) if (i < 50) == (j < 50)] and pairs.count() == len(scored)
    assert dedupe.candidate_pairs(members.limit(0)).count() == 0
    for least in (0.65, 0.85):
        left = {(r.i, r.j) for r in dedupe.may_reach(pairs, least).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect()}
        assert {k for k, r in scored.items() if r.score >= least} <= left < set(scored)
    plain = pairs.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), similarity.cosine(F.col("a.name_embedding"), F.col("b.name_embedding")).alias("c")).collect()
    assert all(scored[r.i, r.j].name == pytest.approx(r.c, abs=1e-12) for r in plain)


def test_embedding_of_names(spark):
    """Against a plain loop over the n-grams of one name."""
    import math

    def plain(name):
        vector, padded = [0.0] * similarity.EMBEDDING_DIM, f" {name.strip().lower()} "
        for n in (2, 3, 4):
            for i in range(len(padded) - n + 1 if name.strip() else 0):
                h = 1469598103934665603
                for ch in padded[i : i + n]:
                    h = (h ^ ord(ch)) * 1099511628211 % 2**64
                vector[h % similarity.EMBEDDING_DIM] += 1.0 if h >> 40 & 1 else -1.0
        norm = math.hypot(*vector) or 1.0
        return [v / norm for v in vector]

    names = ["Quán Cà Phê", "", "a", "  ", "𝔸 b", "Circle K"]
    got = spark.createDataFrame(list(enumerate([*names, None])), "i int, name string").select("i", similarity.embed(F.col("name")).alias("v")).collect()
    for r in got:
        assert r.v == pytest.approx(plain(([*names, None])[r.i] or ""), abs=1e-6)


def test_reject_and_manual_merge(spark):
    s = silver(spark, [(i, "osm_overpass", f"n{i}", 21.0, 105.0, 0.5, None, None, None) for i in (1, 2, 3)])
    out = {r.id: (r.merge_status, r.merge_reason) for r in dedupe.reject(s, [2], "dup").collect()}
    assert out[2] == ("rejected", "dup") and out[1] == ("pending", None)
    assert dedupe.manual_merge(s, [1, 3]).first().merged_processed_ids == [1, 3]
    assert dedupe.manual_merge(dedupe.reject(s, [1, 2, 3], "x"), [1, 2]).count() == 0
    with pytest.raises(ValueError):
        dedupe.manual_merge(s, [])


def test_bronze_is_idempotent(spark):
    records = bronze.with_hash(spark.createDataFrame([(1, "a", '{"x": 1}'), (1, "a", '{"x":1}'), (1, "b", '{"x": 1}')], "source_id int, source_poi_id string, raw_payload string"))
    fresh = bronze.new_records(records, records.limit(0))
    assert fresh.count() == 2 and bronze.new_records(records, fresh).count() == 0
    changed = bronze.with_hash(spark.createDataFrame([(1, "a", '{"x": 2}')], "source_id int, source_poi_id string, raw_payload string"))
    assert bronze.new_records(changed, fresh).count() == 1


def test_requests_and_ids(spark):
    assert adapters.nearby_request(1.0, 2.0, 500, "cafe")["includedTypes"] == ["cafe"]
    asked = adapters.overpass_query(21.0, 105.0, 500, "amenity=cafe")
    assert asked.count("around:500") == 3 and '["amenity"="cafe"]' in asked
    assert adapters.overpass_query(21.0, 105.0, 500, "cafe").count("around:500") == 15
    assert one(spark, adapters.osm_id_parts(F.col("i")), i="osm-way-12").number == 12
    with pytest.raises(Exception, match="not an OSM id"):
        one(spark, adapters.osm_id_parts(F.col("i")), i="osm-house-1")


def test_scraper_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('input_id,link,title,category,address,phone,website,latitude,longitude,review_count,review_rating,data_id,place_id\n1,http://x,Quán A,cafe,"1 A, Hà Nội",,,21.0,105.0,,,,p1\n2,http://y,Quán B,cafe,,,,bad,105.0,,,,\n3,,,,,,,,,,,,\n')
    got = adapters.scraper_records(adapters.read_landing(spark, str(path), "scraper_csv")).collect()
    assert len(got) == 2 and got[0].source_poi_id == "p1" and got[0].lat == 21.0
    assert got[1].source_poi_id.startswith("gosom-") and got[1].lat is None


def test_data_source(spark):
    from terrane.sources.datasource import PlaceSource, grid

    spark.dataSource.register(PlaceSource)
    box = {"west": 105.78, "south": 20.95, "east": 105.92, "north": 21.10}
    got = spark.read.format("places").options(fetcher="terrane.sources.samples:fetch", category="retail", cell_m="5000", **{k: str(v) for k, v in box.items()}).load()
    centres = grid(*box.values(), 5000)
    rows = got.collect()
    assert got.rdd.getNumPartitions() == len(centres) and sorted((r.lat, r.lng) for r in rows) == sorted(centres)
    assert all(r.source_poi_id.startswith("retail-") for r in rows)


def test_unknown_sources_are_left_out(spark):
    raw = spark.createDataFrame([(1, "nowhere", "{}")], "raw_poi_id long, source_code string, raw_payload string")
    assert adapters.extract(raw).count() == 0


def test_fallback_point_keeps_the_row_without_codes(spark):
    raw = spark.createDataFrame([(1, "osm_overpass", '{"type": "way", "id": 3, "tags": {"name": "A"}}', 21.0, 105.8, NOW), (2, "osm_overpass", '{"type": "way", "id": 4, "tags": {"name": "B"}}', None, None, NOW), (3, "osm_overpass", '{"type": "node", "id": 5, "lat": 1, "lon": 2, "tags": {}}', None, None, NOW)], "raw_poi_id long, source_code string, raw_payload string, lat double, lng double, fetched_at timestamp")
    got = normalize.to_silver(adapters.extract(raw), units=refdata.admin_units(spark), as_of=NOW).collect()
    assert [r.raw_poi_id for r in got] == [1] and got[0].province_code is None and got[0].quality_factors.has_coordinates == 0


def test_sliced_rows_go_on(spark):
    plan = spark.createDataFrame([(1, "01", "retail", 5000, 1, "pending", None, 0), (2, "02", "retail", 5000, 2, "pending", None, 0)], "id long, province_code string, openooh_code string, cell_size_m int, priority int, status string, last_attempt_at timestamp, next_cell int")
    units = refdata.admin_units(spark)
    first = crawl.tick(plan, units, 0, 33)
    rows = first.collect()
    assert len(rows) == 33 and {r.id for r in rows} == {1} and [r.cell for r in sorted(rows, key=lambda r: r.turn)] == list(range(33))
    later = crawl.tick(plan.withColumn("next_cell", F.when(F.col("id") == 1, 33).otherwise(0)), units, 0, 33).collect()
    assert min(r.cell for r in later if r.id == 1) == 33
    assert crawl.tick(plan, units, 66, 33).count() == 0 and crawl.tick_budget() == 33


def test_too_many_jobs(spark):
    box = spark.createDataFrame([(105.0, 20.0, 106.0, 21.0)], "lng_min double, lat_min double, lng_max double, lat_max double")
    one_of = lambda c: spark.createDataFrame([("x",)], f"{c} string")
    with pytest.raises(Exception, match="too many jobs"):
        crawl.tiled_jobs(box, one_of("category"), one_of("source"), 5000, 10).collect()


def test_initialize_keeps_and_overwrites(spark):
    wanted = crawl.plan_cells(refdata.admin_units(spark).filter("code IN ('01', '02')"), refdata.taxonomy(spark).filter("level = 1"), refdata.priorities(spark))
    columns = "id long, province_code string, openooh_code string, cell_size_m int, priority int, status string, cells_total int, cells_done int, cells_failed int, pois_raw int, pois_master int, attempts int, last_attempt_at timestamp, completed_at timestamp, error_summary string"
    plan = spark.createDataFrame([(1, "01", "retail", 500, 7, "done", 9, 9, 0, 5, 4, 3, NOW, NOW, None)], columns)
    kept, counts = crawl.initialize(plan, wanted)
    assert counts.first().asDict() == {"inserted": 35, "skipped": 1, "overwritten": 0, "total": 36}
    assert kept.filter("province_code = '01' AND openooh_code = 'retail'").first().status == "done"
    anew = crawl.initialize(plan, wanted, overwrite=True)[0].filter("id = 1").first()
    assert (anew.status, anew.cells_done, anew.pois_raw, anew.attempts, anew.priority) == ("pending", 0, 5, 3, 50)


def test_streams(spark, tmp_path):
    from terrane.streaming import incremental

    landing, seen = tmp_path / "in", []
    landing.mkdir()
    (landing / "a.json").write_text('{"source_id": 1, "source_poi_id": "a", "raw_payload": "{\\"x\\": 1}", "fetched_at": "2024-01-01T00:00:00Z"}\n' * 2)
    schema = spark.createDataFrame([], "source_id int, source_poi_id string, raw_payload string, fetched_at timestamp").schema
    stream = incremental.dedupe_stream(incremental.landing_stream(spark, str(landing), schema))
    query = incremental.run_batches(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "c"))
    assert query.awaitTermination(120) and sum(seen) == 1
    calls = incremental.rate_stream(spark.readStream.schema("ts timestamp, client_id long").json(str(landing)))
    assert calls.isStreaming and calls.columns == ["client_id", "window_start", "calls"]


def test_versions_of_a_table(spark, tmp_path):
    from terrane.sources import tables

    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.read_version(spark, path)
    units = tables.conform(refdata.admin_units(spark), "admin_units")
    assert tables.write_version(units, path) == 1
    assert tables.write_version(tables.read_version(spark, path).filter("level = 1"), path) == 2
    (tmp_path / "t" / "v=3").mkdir()  # a write that failed
    assert tables.read_version(spark, path).count() == 63 and tables.read_version(spark, path, 1).count() == 125
    assert tables.conform(spark.range(1), "crawl_plan").columns[0] == "id" and all(tables.conform(spark.range(0), t).columns for t in tables.SCHEMAS)
