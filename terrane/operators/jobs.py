"""Ingestion jobs: create, get, count, start. What a run leaves is in bronze.finish_job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bronze import job_error

PARAMETERS = ("lat", "lng", "radius_m", "category", "source_poi_id")


def create_jobs(requests: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """One row a request (id, source_code, job_type and PARAMETERS): id, source_id, job_type, params as JSON of what is given,
    status, created_at and error. A request that can't become a job has an error and no status.
    """
    known = sources.select(F.col("code").alias("source_code"), F.col("id").alias("source_id"))
    asked = requests.join(known, "source_code", "left")
    error = F.when(F.col("source_id").isNull(), "unknown source").otherwise(job_error(F.col("job_type"), *[F.col(c) for c in PARAMETERS]))
    made = asked.withColumn("error", error)
    return made.select("id", "source_id", "job_type", F.to_json(F.struct(*PARAMETERS)).alias("params"), F.when(F.col("error").isNull(), "pending").alias("status"), F.when(F.col("error").isNull(), as_of).alias("created_at"), "error")


def get_job(jobs: DataFrame, job_id: int) -> DataFrame:
    """The job of an id, or no row."""
    return jobs.filter(F.col("id") == job_id)


def count_jobs(jobs: DataFrame, sources: DataFrame, source_code: str | None = None, status: str | None = None) -> DataFrame:
    """total: how many jobs have the source and the status."""
    out = jobs if status is None else jobs.filter(F.col("status") == status)
    if source_code is not None:
        out = out.join(sources.filter(F.col("code") == source_code).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return out.agg(F.count("*").alias("total"))


def start_jobs(jobs: DataFrame, as_of: Column, ids: DataFrame | None = None) -> DataFrame:
    """Jobs where pending ones (of `ids`, a table of id, if given) are running since as_of; all others stay as they are."""
    chosen = F.col("status") == "pending"
    out = jobs
    if ids is not None:
        out = jobs.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
        chosen = chosen & F.col("_asked").isNotNull()
    if "started_at" not in out.columns:
        out = out.withColumn("started_at", F.lit(None).cast("timestamp_ntz"))
    hit = F.coalesce(chosen, F.lit(False))
    return out.withColumn("started_at", F.when(hit, as_of).otherwise(F.col("started_at"))).withColumn("status", F.when(hit, "running").otherwise(F.col("status"))).drop("_asked")
