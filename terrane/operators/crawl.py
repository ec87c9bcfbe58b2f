"""Crawl planning: the province by category matrix, tiles, the queue and the progress of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.geo import tile_centers

# Fixed values of the planner.
STATUSES = ("pending", "in_progress", "done", "failed", "paused")
PRIORITY_PROVINCES = ("01", "79", "48", "31", "92", "22", "75", "74", "68")
DEFAULT_PRIORITY, PRIORITY_BONUS = 100, 50
RATE_PER_HOUR, TICK_MINUTES, BATCH_CAP, TICK_ROWS = 200, 10, 50, 5
PAUSE_MIN_TOTAL, PAUSE_MIN_FAILED, PAUSE_RATE = 10, 5, 0.5
MAX_JOBS = 500


def plan_cells(provinces: DataFrame, categories: DataFrame, priorities: DataFrame, cell_size_m: int = 5000) -> DataFrame:
    """Every province with every category: a product of two dimensions, both of them bounded lists."""
    if not 500 <= cell_size_m <= 20000:
        raise ValueError("cell_size_m out of bounds")
    bonus = F.when(F.col("province_code").isin(*PRIORITY_PROVINCES), PRIORITY_BONUS).otherwise(0)
    codes = categories.select(F.col("code").alias("openooh_code")).join(F.broadcast(priorities.select(F.col("code").alias("openooh_code"), "priority")), "openooh_code", "left")
    return provinces.select(F.col("code").alias("province_code")).crossJoin(F.broadcast(codes)).select("province_code", "openooh_code", F.lit(cell_size_m).alias("cell_size_m"), (F.coalesce("priority", F.lit(DEFAULT_PRIORITY)) - bonus).alias("priority"), F.lit("pending").alias("status"))


def initialize(plan: DataFrame, wanted: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(plan, counts inserted, skipped, overwritten, total): rows that exist stay, or start anew when overwriting.

    Starting anew keeps pois_raw, pois_master and attempts.
    """
    key = ["province_code", "openooh_code"]
    both = plan.select(*key, F.struct(*plan.columns).alias("o")).join(wanted.select(*key, F.struct(*wanted.columns).alias("w")), key, "full_outer")
    reset = {"status": F.lit("pending"), "cells_done": F.lit(0), "cells_failed": F.lit(0), "cells_total": F.lit(None), "completed_at": F.lit(None), "error_summary": F.lit(None)}
    hit = F.col("o").isNotNull() & F.col("w").isNotNull() & F.lit(overwrite)
    fresh = F.col("o").isNull()

    def cell(c: str) -> Column:
        kind = plan.schema[c].dataType
        new = F.col(f"w.{c}") if c in wanted.columns else reset.get(c, F.lit(0) if c in ("pois_raw", "pois_master", "attempts") else F.lit(None))
        again = F.col(f"w.{c}") if c in ("cell_size_m", "priority") else reset.get(c, F.col(f"o.{c}"))
        return F.when(fresh, new.cast(kind)).when(hit, again.cast(kind)).otherwise(F.col(f"o.{c}")).alias(c)

    counts = both.agg(F.count_if(fresh).alias("inserted"), F.count_if(F.col("o").isNotNull() & F.col("w").isNotNull() & ~F.lit(overwrite)).alias("skipped"), F.count_if(hit).alias("overwritten"), F.count_if(F.col("w").isNotNull()).alias("total"))
    return both.select(*[F.col(c) if c in key else cell(c) for c in plan.columns]), counts


def status_report(plan: DataFrame, as_of: Column) -> DataFrame:
    """Counts by status, cells, places, the last completion and when the rest may be done."""
    count = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cells_total", "cells_done", "cells_failed", "pois_raw", "pois_master")]
    recent = F.count_if((F.col("status") == "done") & (F.col("completed_at") >= as_of - F.expr("INTERVAL 24 HOURS"))).alias("done_24h")
    out = plan.agg(F.count("*").alias("total"), *count, *sums, F.max("completed_at").alias("last_completed_at"), recent)
    left = F.col("pending") + F.col("in_progress")
    return out.withColumn("eta_days", F.when((F.col("done_24h") > 0) & (left > 0), F.round(left / F.col("done_24h"), 2)))


def velocity(jobs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Finished crawl jobs and places by hour."""
    rows = jobs.filter((F.col("completed_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))) & has_key(F.col("params"), "crawl_plan_id"))
    count = F.get_json_object("stats", "$.raw_count").cast("int")
    return rows.groupBy(F.date_trunc("hour", "completed_at").alias("hour")).agg(F.count_if(F.col("status") == "completed").alias("jobs_done"), F.count_if(F.col("status") == "failed").alias("jobs_failed"), F.coalesce(F.sum(F.when(F.col("status") == "completed", count)), F.lit(0)).alias("pois")).orderBy("hour")


def has_key(json: Column, key: str) -> Column:
    """Whether a JSON object has a key, a null value too."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def matrix(plan: DataFrame, provinces: DataFrame, taxonomy: DataFrame, province: str | None = None, level: int | None = None) -> DataFrame:
    """Plan rows with the province's name, by name and category."""
    named = provinces.select(F.col("code").alias("province_code"), F.col("name").alias("province_name"))
    out = plan.join(F.broadcast(named), "province_code")
    if province is not None:
        out = out.filter(F.col("province_code") == province)
    if level is not None:
        out = out.join(F.broadcast(taxonomy.filter(F.col("level") == level).select(F.col("code").alias("openooh_code"))), "openooh_code", "left_semi")
    return out.orderBy("province_name", "openooh_code")


def failed_rows(plan: DataFrame, provinces: DataFrame, limit: int = 50) -> DataFrame:
    named = provinces.select(F.col("code").alias("province_code"), F.col("name").alias("province_name"))
    return plan.filter("status = 'failed'").join(F.broadcast(named), "province_code").orderBy(F.desc_nulls_last("last_attempt_at"), "id").limit(limit)


def transition(plan: DataFrame, action: str) -> DataFrame:
    """pause: pending to paused; resume: paused to pending; retry_failed: failed to pending with its cells counted anew."""
    before, after = {"pause": ("pending", "paused"), "resume": ("paused", "pending"), "retry_failed": ("failed", "pending")}[action]
    hit = F.col("status") == before
    out = plan
    if action == "retry_failed":
        for c in ("cells_done", "cells_failed"):
            out = out.withColumn(c, F.when(hit, 0).otherwise(F.col(c)))
        out = out.withColumn("error_summary", F.when(hit, F.lit(None)).otherwise(F.col("error_summary")))
    return out.withColumn("status", F.when(hit, after).otherwise(F.col("status")))


def tick_budget(rate_per_hour: int = RATE_PER_HOUR, minutes: int = TICK_MINUTES, cap: int = BATCH_CAP) -> int:
    return min(max(1, max(1, rate_per_hour) * max(1, minutes) // 60), cap)


def next_rows(plan: DataFrame, limit: int = TICK_ROWS) -> DataFrame:
    """The queue's head: priority, then rows never tried, then the oldest attempt."""
    return plan.filter("status = 'pending'").orderBy("priority", F.asc_nulls_first("last_attempt_at"), "id").limit(limit)


def tick(plan: DataFrame, provinces: DataFrame, in_flight: int, budget: int, start: str = "next_cell") -> DataFrame:
    """Jobs of a tick: cells of the next rows in order, as many as the budget allows; none while twice the budget is in flight.

    A row that doesn't fit whole goes on from its next_cell in a later tick, so it can reach its total.
    """
    rows = next_rows(plan).filter(F.lit(in_flight < 2 * budget))
    box = provinces.select(F.col("code").alias("province_code"), "lng_min", "lat_min", "lng_max", "lat_max")
    tiled = rows.join(F.broadcast(box), "province_code").withColumn("cells", tile_centers(F.col("lng_min"), F.col("lat_min"), F.col("lng_max"), F.col("lat_max"), F.col("cell_size_m").cast("double")))
    begin = F.coalesce(F.col(start), F.lit(0)) if start in plan.columns else F.lit(0)
    cells = tiled.select("id", "priority", "last_attempt_at", "openooh_code", "cell_size_m", F.size("cells").alias("cells_total"), begin.alias("begin"), F.posexplode("cells").alias("cell", "at")).filter("cell >= begin")
    # At most TICK_ROWS rows reach this order, so one task can hold it.
    order = Window.orderBy("priority", F.asc_nulls_first("last_attempt_at"), "id", "cell")
    return cells.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= budget).select("id", "openooh_code", "cells_total", "cell", F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"), F.floor(F.col("cell_size_m") / 2).cast("int").alias("radius_m"), "turn")


def apply_outcomes(plan: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Plan rows after a batch of job outcomes (plan_id, success, raw_count, error).

    Done when every cell has an outcome and one succeeded; failed when none did.
    """
    sums = outcomes.groupBy("plan_id").agg(F.count_if("success").alias("_ok"), F.count_if(~F.col("success")).alias("_bad"), F.sum(F.when(F.col("success"), F.col("raw_count")).otherwise(0)).alias("_raw"), F.max(F.when(~F.col("success"), F.col("error"))).alias("_error"))
    joined = plan.join(sums, plan["id"] == sums["plan_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    done, failed = zero("cells_done") + zero("_ok"), zero("cells_failed") + zero("_bad")
    closed = (F.col("status") == "in_progress") & F.col("cells_total").isNotNull() & F.col("plan_id").isNotNull() & (done + failed >= F.col("cells_total"))
    changed = {
        "cells_done": done.cast("int"),
        "cells_failed": failed.cast("int"),
        "pois_raw": (zero("pois_raw") + zero("_raw")).cast("int"),
        "error_summary": F.coalesce("_error", "error_summary"),
        "status": F.when(closed & (done == 0), "failed").when(closed, "done").otherwise(F.col("status")),
        "completed_at": F.when(closed, as_of).otherwise(F.col("completed_at")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in plan.columns])


def recount_masters(plan: DataFrame, masters: DataFrame) -> DataFrame:
    """pois_master of each row: active masters of the province whose subcategory, or category where there is none, is its
    code; a group that is gone counts 0."""
    counts = masters.filter("status = 'active'").groupBy("province_code", F.coalesce("openooh_subcategory", "openooh_category").alias("openooh_code")).agg(F.count("*").alias("_n"))
    joined = plan.join(counts, ["province_code", "openooh_code"], "left")
    return joined.select(*[F.coalesce("_n", F.lit(0)).cast("int").alias(c) if c == "pois_master" else F.col(c) for c in plan.columns])


def auto_pause(plan: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    """Pending rows pause when more than half of at least ten crawl jobs of the last 30 minutes failed, five at least."""
    recent = jobs.filter((F.col("completed_at") >= as_of - F.expr("INTERVAL 30 MINUTES")) & F.col("status").isin("completed", "failed") & has_key(F.col("params"), "crawl_plan_id"))
    surge = recent.agg(F.count("*").alias("t"), F.count_if(F.col("status") == "failed").alias("f")).select(((F.col("t") >= PAUSE_MIN_TOTAL) & (F.col("f") >= PAUSE_MIN_FAILED) & (F.col("f") / F.greatest("t", F.lit(1)) > PAUSE_RATE)).alias("_surge"))
    return plan.join(F.broadcast(surge)).withColumn("status", F.when(F.col("_surge") & (F.col("status") == "pending"), "paused").otherwise(F.col("status"))).drop("_surge")


def heatmap(plan: DataFrame, categories: list[str]) -> DataFrame:
    """Percent of cells done by province and top-level category, provinces with the highest mean first."""
    rows = plan.withColumn("top", F.substring_index("openooh_code", ".", 1))
    pct = F.round(100.0 * F.count_if(F.col("status") == "done") / F.count("status"), 1)
    cells = rows.groupBy("province_code").pivot("top", categories).agg(pct).fillna(0.0)
    return cells.withColumn("mean", F.round(sum((F.col(c) for c in categories), F.lit(0.0)) / len(categories), 4)).orderBy(F.desc("mean"), "province_code")


def expand_provinces(wanted: DataFrame, regions: DataFrame) -> DataFrame:
    """Provinces of region codes and of plain codes, each once, in the order they were first named."""
    expanded = wanted.join(F.broadcast(regions.select(F.col("code").alias("wanted"), "province_codes")), "wanted", "left")
    listed = expanded.select("pos", F.posexplode(F.when(F.col("province_codes").isNotNull(), F.col("province_codes")).otherwise(F.array("wanted"))).alias("at", "province_code"))
    return listed.groupBy("province_code").agg(F.min(F.struct("pos", "at")).alias("first")).orderBy("first").select("province_code")


def tiled_jobs(boxes: DataFrame, categories: DataFrame, sources: DataFrame, cell_size_m: int, max_jobs: int = MAX_JOBS) -> DataFrame:
    """Jobs of an area: its cells by categories by sources; more than max_jobs are an error raised by the plan itself."""
    cells = boxes.select(F.explode(tile_centers(F.col("lng_min"), F.col("lat_min"), F.col("lng_max"), F.col("lat_max"), F.lit(float(cell_size_m)))).alias("at"))
    jobs = cells.crossJoin(F.broadcast(categories.select("category"))).crossJoin(F.broadcast(sources.select("source")))
    made = jobs.select("source", "category", F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"), F.lit(cell_size_m // 2).alias("radius_m"))
    guard = made.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > max_jobs, F.raise_error(F.concat(F.lit("too many jobs: "), F.col("_n").cast("string")))).alias("_guard"))
    return made.join(F.broadcast(guard)).filter(F.col("_guard").isNull()).drop("_guard")


def list_jobs(jobs: DataFrame, sources: DataFrame, source: str | None = None, status: str | None = None) -> DataFrame:
    """Jobs with the code of their source, newest first."""
    out = jobs.join(F.broadcast(sources.select(F.col("id").alias("source_id"), F.col("code").alias("source_code"))), "source_id")
    if source is not None:
        out = out.filter(F.col("source_code") == source)
    if status is not None:
        out = out.filter(F.col("status") == status)
    return out.orderBy(F.desc("id"))


def coverage_browser(plan: DataFrame, text: str = "", status: str | None = None, limit: int = 100) -> DataFrame:
    """Rows whose province or category contains a text, whatever the case."""
    out = plan.filter(F.col("openooh_code").ilike(f"%{text}%") | F.col("province_code").ilike(f"%{text}%"))
    return (out if status is None else out.filter(F.col("status") == status)).orderBy("province_code", "openooh_code").limit(limit)
