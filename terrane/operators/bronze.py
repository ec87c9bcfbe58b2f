"""Bronze: content-hash de-duplication, upserts of seeds, archive, job validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import content_hash

KEY = ("source_id", "source_poi_id", "content_hash")
JOB_TYPES = ("area_sweep", "category_search", "detail_enrich", "backfill")
JOB_STATUSES = ("pending", "running", "completed", "failed", "cancelled")


def with_hash(records: DataFrame, payload: str = "raw_payload") -> DataFrame:
    return records.withColumn("content_hash", content_hash(F.col(payload)))


def new_records(incoming: DataFrame, existing: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """Rows to append: the first of each key that the bronze table lacks. Rerun on its own output, nothing is new.

    One shuffle on the key serves the in-batch choice and the anti join.
    """
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def ingest_stats(incoming: DataFrame, fresh: DataFrame) -> DataFrame:
    """fetched, new, duplicate, errors (records without an id, or whose payload has no content hash), raw_count."""
    bad = F.col("source_poi_id").isNull() | (F.length("source_poi_id") > 255)
    if "content_hash" in incoming.columns:
        bad = bad | F.col("content_hash").isNull()
    seen = incoming.agg(F.count("*").alias("fetched"), F.count_if(bad).alias("errors"))
    added = fresh.agg(F.count("*").alias("new"))
    return seen.join(F.broadcast(added)).select("fetched", "new", (F.col("fetched") - F.col("new") - F.col("errors")).alias("duplicate"), "errors", F.col("new").alias("raw_count"))


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The current table with the incoming rows put over it; columns in `keep` stay as they are on rows that exist."""
    both = current.select(F.col(key), F.struct(*current.columns).alias("_old")).join(incoming.select(F.col(key), F.struct(*incoming.columns).alias("_new")), key, "full_outer")
    pick = lambda c: F.when(F.col("_old").isNotNull() & F.lit(c in keep) | F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}") if c in incoming.columns else F.col(f"_old.{c}"))
    return both.select(*[F.col(key) if c == key else pick(c).alias(c) for c in current.columns])


def archive_split(raw: DataFrame, as_of: Column, days: int = 365) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): rows fetched more than `days` days before as_of go to the archive."""
    old = F.col("fetched_at") < as_of - F.make_dt_interval(F.lit(days))
    return raw.filter(~old | F.col("fetched_at").isNull()), raw.filter(old)


def district_code(province: Column, district: Column) -> Column:
    """Code PP.DDD, zero-padded."""
    return F.format_string("%s.%s", F.lpad(province.cast("string"), 2, "0"), F.lpad(district.cast("string"), 3, "0"))


def job_error(job_type: Column, lat: Column, lng: Column, radius_m: Column, category: Column, source_poi_id: Column) -> Column:
    """Why a job cannot run, or null."""
    area = lat.isNull() | lng.isNull() | radius_m.isNull()
    return (
        F.when(~job_type.isin(*JOB_TYPES), "unknown job type")
        .when(job_type == "backfill", "backfill is not supported")
        .when(job_type.isin("area_sweep", "category_search") & area, "lat, lng and radius_m are required")
        .when((job_type == "category_search") & category.isNull(), "category is required")
        .when((job_type == "detail_enrich") & source_poi_id.isNull(), "source_poi_id is required")
    )


def finish_job(jobs: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Jobs with the outcome of a run (job_id, new, error): completed, or failed with at most 2,000 characters of error."""
    hit = F.col("_job").isNotNull()
    done = F.when(hit & F.col("_error").isNotNull(), "failed").when(hit, "completed").otherwise(F.col("status"))
    out = results.select(F.col("job_id").alias("_job"), F.col("new").alias("_new"), F.col("error").alias("_error"))
    joined = jobs.join(out, jobs["id"] == out["_job"], "left")
    return joined.select(*[{"status": done, "completed_at": F.when(hit, as_of).otherwise(F.col("completed_at")), "error_message": F.when(hit, F.substring("_error", 1, 2000)).otherwise(F.col("error_message"))}.get(c, F.col(c)).alias(c) for c in jobs.columns])
