"""Layer tables: fixed schemas, and Parquet folders that get a new version instead of being changed."""

from __future__ import annotations

import threading

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.bronze import archive_split
from terrane.plans.scratch import materialize

#: Writers of one driver claim versions one after another; those of several are told apart by the file system.
_CLAIMING = threading.Lock()
_ADDRESS = "STRUCT<house_number: STRING, street: STRING, ward: STRING, district: STRING, province: STRING, country: STRING, confidence: DOUBLE>"
_FACTORS = "STRUCT<completeness: DOUBLE, freshness: DOUBLE, source_reliability: DOUBLE, address_confidence: DOUBLE, phone_valid: DOUBLE, has_coordinates: DOUBLE>"

#: Columns of the layers.
SCHEMAS = {
    "sources": "id INT, code STRING, name STRING, config STRING, enabled BOOLEAN, priority INT",
    "raw_pois": "id BIGINT, source_id INT, source_poi_id STRING, raw_payload STRING, content_hash STRING, lat DOUBLE, lng DOUBLE, fetched_at TIMESTAMP, ingestion_job_id BIGINT, processed_at TIMESTAMP",
    "processed_pois": "id BIGINT, raw_poi_id BIGINT, name_original STRING, name_normalized STRING, name_embedding ARRAY<FLOAT>, address_original STRING, address_normalized STRING, "
    f"address_components {_ADDRESS}, phone_original STRING, phone_e164 STRING, website STRING, website_domain STRING, openooh_category STRING, openooh_subcategory STRING, raw_category STRING, brand STRING, "
    f"brand_confidence DECIMAL(3,2), lat DOUBLE, lng DOUBLE, quality_score DECIMAL(3,2), quality_factors {_FACTORS}, province_code STRING, district_code STRING, ward_code STRING, merged_into STRING, merge_status STRING, merge_reason STRING",
    "master_pois": f"id STRING, canonical_name STRING, canonical_name_embedding ARRAY<FLOAT>, canonical_address STRING, canonical_address_components {_ADDRESS}, canonical_phone STRING, canonical_website STRING, lat DOUBLE, lng DOUBLE, "
    "openooh_category STRING, openooh_subcategory STRING, brand STRING, province_code STRING, district_code STRING, ward_code STRING, source_refs ARRAY<STRUCT<source: STRING, source_poi_id: STRING, raw_poi_id: BIGINT>>, "
    "merged_processed_ids ARRAY<BIGINT>, sources_count INT, confidence DECIMAL(3,2), quality_score DECIMAL(3,2), status STRING, version INT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "master_poi_history": "id BIGINT, master_poi_id STRING, version INT, changed_fields ARRAY<STRING>, previous_values STRING, new_values STRING, change_reason STRING, changed_at TIMESTAMP",
    "ingestion_jobs": "id BIGINT, source_id INT, job_type STRING, params STRING, status STRING, stats STRING, started_at TIMESTAMP, completed_at TIMESTAMP, error_message STRING, created_at TIMESTAMP",
    "brands": "ord INT, name STRING, aliases ARRAY<STRING>, category STRING, parent_company STRING, match_pattern STRING, enabled BOOLEAN",
    "openooh_categories": "code STRING, name STRING, parent_code STRING, level INT",
    "admin_units": "code STRING, name STRING, parent_code STRING, level INT, lng_min DOUBLE, lat_min DOUBLE, lng_max DOUBLE, lat_max DOUBLE",
    "crawl_plan": "id BIGINT, province_code STRING, openooh_code STRING, cell_size_m INT, priority INT, status STRING, cells_total INT, cells_done INT, cells_failed INT, pois_raw INT, pois_master INT, attempts INT, last_attempt_at TIMESTAMP, completed_at TIMESTAMP, error_summary STRING",
    "api_clients": "id INT, name STRING, key_hash STRING, permissions ARRAY<STRING>, rate_limit_per_minute INT, enabled BOOLEAN",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table in order and type; columns that are missing are null, others are left out."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table: those whose writer left its success mark."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _claim(spark: SparkSession, path: str) -> int:
    """The number of the next version, for this writer alone: the file that names it can be created once."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with _CLAIMING:
        number = max(_versions(spark, path), default=0) + 1
        while True:
            try:
                fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{number}"), False).close()
                return number
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                number += 1


def write_version(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write the whole table as its next version; readers of older ones aren't disturbed, a failed write is never read, and two writers
    never take one number (several drivers, on a file system that creates a file once, as HDFS does)."""
    version = _claim(df.sparkSession, path)
    df.write.mode("error").partitionBy(*partition_by).parquet(f"{path}/v={version}")
    return version


def archive_months(raw: DataFrame, path: str, as_of: Column, days: int = 365, at: str = "fetched_at", key: str = "id") -> DataFrame:
    """Move rows fetched more than `days` days before as_of to an archive in partitions by month; the rows to keep come back.

    Only the months that get rows are written, each as a whole, with what it held before; a row that is there already is not moved
    again, so a run that failed half-way, or one over the same rows, can be repeated.
    """
    spark = raw.sparkSession
    kept, old = archive_split(raw, as_of, days)
    moved = materialize(old.withColumn("month", F.date_format(at, "yyyy-MM")), "moved")
    if not moved.isEmpty():
        both = moved
        if _exists(spark, path):
            before = spark.read.schema(moved.schema).parquet(path).join(F.broadcast(moved.select("month").distinct()), "month", "left_semi")
            both = before.select(*moved.columns).unionByName(moved.join(before.select(key), key, "left_anti").select(*moved.columns))
        months = materialize(both, "months")
        months.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return kept


def _exists(spark: SparkSession, path: str) -> bool:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)


def read_version(spark: SparkSession, path: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """The newest complete version of a table, or the one asked for."""
    found = _versions(spark, path)
    if not found or (version is not None and version not in found):
        raise FileNotFoundError(f"no such version of {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/v={version or found[-1]}")
