"""Operations figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kpi_row(raw: DataFrame, silver: DataFrame, masters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Eight counts over four tables, one aggregation each; the rows are joined as single rows."""
    a = raw.agg(F.count("*").alias("raw_total"), F.count_if(F.col("processed_at").isNull()).alias("raw_unprocessed"))
    b = silver.agg(F.count("*").alias("processed_total"), F.count_if(F.col("merge_status") == "pending").alias("pending_merge"))
    c = masters.agg(F.count_if(F.col("status") == "active").alias("masters_active"), F.count_if(F.col("sources_count") > 1).alias("masters_multi_source"))
    d = jobs.agg(F.count_if(F.col("status").isin("pending", "running")).alias("jobs_in_flight"), F.count_if(F.col("status") == "failed").alias("jobs_failed"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(d))


def per_source(sources: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows and last fetch of every source; sources without rows count 0. Bronze is aggregated before the join."""
    counts = raw.groupBy("source_id").agg(F.count("*").alias("_n"), F.max("fetched_at").alias("last_fetched"))
    return sources.join(counts, sources["id"] == counts["source_id"], "left").select("code", F.coalesce("_n", F.lit(0)).alias("n"), "last_fetched")


def hourly(rows: DataFrame, at: str, as_of: Column, hours: int = 24) -> DataFrame:
    """Rows by hour over the last hours."""
    return rows.filter(F.col(at) >= as_of - F.make_dt_interval(hours=F.lit(hours))).groupBy(F.date_trunc("hour", at).alias("hour")).agg(F.count("*").alias("n")).orderBy("hour")


def by_status(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n")).orderBy("status")


def rate_windows(calls: DataFrame, at: str = "ts", client: str = "client_id", limit: int = 60, window: str = "1 minute") -> DataFrame:
    """Calls of a client by fixed window, and whether they are over its limit."""
    return calls.groupBy(F.col(client).alias("client_id"), F.window(at, window)["start"].alias("window_start")).agg(F.count("*").alias("calls")).withColumn("limited", F.col("calls") > limit)


def metric_lines(counters: DataFrame, prefix: str = "terrane") -> DataFrame:
    """Counters (name, labels as a map, value) as lines of the text exposition format, ready for a text sink."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(e["value"], F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    braces = F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise("")
    return counters.select(F.concat(F.lit(f"{prefix}_"), F.col("name"), braces, F.lit(" "), F.col("value").cast("string")).alias("line"))


def ordered_union(first: Column, second: Column) -> Column:
    """Both lists without repeats, in the order of first mention."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))
