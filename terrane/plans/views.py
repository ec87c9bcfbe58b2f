"""Place-like views of the driver's tables. Each column is one expression that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROVINCE = "lpad(CAST({} % 63 + 1 AS STRING), 2, '0')"
#: Customers in fives are neighbours: a place.
SPOT = "CAST(floor(c_custkey / 5) AS BIGINT)"
LAT = "8 + CAST(({0} * 7919) % 1500 AS DOUBLE) / 100"
LNG = "102 + CAST(({0} * 104729) % 700 AS DOUBLE) / 100"

MASTERS = (
    "part",
    {
        "id": "p_partkey",
        "canonical_name": "p_name",
        "canonical_address": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(lower(p_type), ' street ', CAST(p_size AS STRING)) END",
        "openooh_category": "lower(p_type)",
        "openooh_subcategory": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE concat(lower(p_type), '.s', CAST(p_size % 4 AS STRING)) END",
        "brand": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END",
        "province_code": PROVINCE.format("p_partkey"),
        "district_code": f"CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat({PROVINCE.format('p_partkey')}, '.00', CAST(p_partkey % 9 AS STRING)) END",
        "ward_code": "CAST(NULL AS STRING)",
        "confidence": "CAST(p_partkey * 37 % 101 AS DOUBLE) / 100",
        "status": "CASE WHEN p_partkey % 10 = 0 THEN 'archived' ELSE 'active' END",
        "updated_at": "p_partkey % 365",
        "lat": LAT.format("p_partkey"),
        "lng": LNG.format("p_partkey"),
        "sources_count": "1 + p_partkey % 3",
    },
)
PLAN = (
    "orders",
    {
        "id": "o_orderkey",
        "province_code": "lpad(CAST(o_custkey % 25 + 1 AS STRING), 2, '0')",
        "openooh_code": "concat(lower(split_part(o_orderpriority, '-', 2)), '.s', CAST(o_orderkey % 4 AS STRING))",
        "cell_size_m": "5000",
        "priority": "CAST(o_custkey % 50 AS INT)",
        "status": "CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'paused' END",
        "cells_total": "CAST(o_orderkey % 9 + 1 AS INT)",
        "cells_done": "CAST(o_orderkey % 4 AS INT)",
        "cells_failed": "CAST(o_orderkey % 3 AS INT)",
        "pois_raw": "CAST(o_custkey % 100 AS INT)",
        "pois_master": "CAST(o_custkey % 10 AS INT)",
        "attempts": "CAST(o_orderkey % 2 AS INT)",
        "last_attempt_at": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END",
        "completed_at": "CASE WHEN o_orderkey % 5 IN (2, 3) THEN o_orderdate ELSE NULL END",
        "error_summary": "CASE WHEN o_orderkey % 5 = 3 THEN o_orderpriority ELSE NULL END",
    },
)
JOBS = (
    "events",
    {
        "id": "event_id",
        "source_id": "CAST(user_id % 5 + 1 AS INT)",
        "status": "CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'pending' END",
        "params": "CASE WHEN event_id % 4 = 0 THEN '{\"lat\": 1}' WHEN event_id % 4 = 1 THEN '{\"crawl_plan_id\": null}' ELSE concat('{\"crawl_plan_id\": ', CAST(user_id AS STRING), '}') END",
        "stats": "concat('{\"raw_count\": ', CAST(event_id % 17 AS STRING), '}')",
        "completed_at": "ts",
    },
)
RAW = (
    "events",
    {
        "id": "event_id",
        "source_id": "CAST(user_id % 6 + 1 AS INT)",
        "source_poi_id": "concat('poi-', CAST(user_id AS STRING))",
        "raw_payload": "props",
        "fetched_at": "ts",
        "ingestion_job_id": "event_id % 50",
        "processed_at": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END",
        "lat": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE " + LAT.format("event_id") + " END",
        "lng": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE " + LNG.format("event_id") + " END",
    },
)
SILVER = (
    "customer",
    {
        "id": "c_custkey",
        "raw_poi_id": "c_custkey + 1000",
        "source_poi_id": "concat('src-', CAST(c_custkey AS STRING))",
        "source_code": "CASE c_custkey % 4 WHEN 0 THEN 'google_places' WHEN 1 THEN 'osm_overpass' WHEN 2 THEN 'gosom_scraper' ELSE 'elsewhere' END",
        "name_original": "CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END",
        # Two streets without a letter in common, so their similarity is 0 in any measure.
        "address_normalized": "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 4 < 3 THEN 'abba' ELSE 'xyxy' END",
        "phone_e164": f"CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('+8490', lpad(CAST(({SPOT} + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) % 50 AS STRING), 7, '0')) END",
        "website": "CAST(NULL AS STRING)",
        "website_domain": f"CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('s', CAST(({SPOT} + c_custkey % 8) % 3 AS STRING), '.vn') END",
        "openooh_category": "lower(c_mktsegment)",
        "openooh_subcategory": "CAST(NULL AS STRING)",
        "brand": f"CASE WHEN c_nationkey % 4 = 0 THEN NULL WHEN c_nationkey % 4 = 1 THEN c_mktsegment ELSE concat('B', CAST({SPOT} % 7 AS STRING)) END",
        "quality_score": "CAST(c_custkey * 13 % 101 AS DOUBLE) / 100",
        "merge_status": "CASE WHEN c_custkey % 9 = 0 THEN 'merged' ELSE 'pending' END",
        "province_code": "lpad(CAST(c_nationkey % 5 + 1 AS STRING), 2, '0')",
        "district_code": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_nationkey % 3 AS STRING) END",
        "ward_code": "CAST(NULL AS STRING)",
        # At any size: places of four or five points, 11 metres from one to the next, and one long chain of points 22 metres apart.
        "lat": f"CASE WHEN c_custkey % 10 = 3 THEN 20.5 + CAST(floor(c_custkey / 10) AS DOUBLE) / 5000 ELSE 21 + CAST(({SPOT} * 7919) % 1500 AS DOUBLE) / 100 + CAST(c_custkey % 5 AS DOUBLE) / 10000 END",
        "lng": f"CASE WHEN c_custkey % 10 = 3 THEN 104.5 ELSE 105 + CAST(({SPOT} * 104729) % 7000 AS DOUBLE) / 100 END",
    },
)
PROVINCES = (
    "nation",
    {
        "code": "lpad(CAST(n_nationkey + 1 AS STRING), 2, '0')",
        "name": "n_name",
        "level": "CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END",
        "lng_min": "CAST(102 + n_nationkey % 5 AS DOUBLE)",
        "lat_min": "CAST(8 + n_nationkey % 7 AS DOUBLE)",
        "lng_max": "CAST(102 + n_nationkey % 5 + 1 + n_nationkey % 3 AS DOUBLE)",
        "lat_max": "CAST(8 + n_nationkey % 7 + 1 + n_nationkey % 4 AS DOUBLE)",
    },
)
SOURCES = ("region", {"id": "r_regionkey + 1", "code": "lower(r_name)", "priority": "r_regionkey * 10"})


def frame(spark: SparkSession, sf_dir: str, view: tuple[str, dict[str, str]]) -> DataFrame:
    """The view as a DataFrame: a projection on the scan."""
    table, columns = view
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def sql(view: tuple[str, dict[str, str]]) -> str:
    """The view as a subquery."""
    table, columns = view
    return "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table})"
