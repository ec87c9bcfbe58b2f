"""Queries over gold and bronze: filters, pages, roll-ups, lineage, audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.functions.geo import geodesic_m, in_bbox, within_radius

PAGE, MAX_PAGE, MAX_RADIUS_M, TOKENS = 50, 200, 200_000, 5


def poi_filter(
    lat: float | None = None,
    lng: float | None = None,
    radius_m: float | None = None,
    category: str | None = None,
    brand: str | None = None,
    province: str | None = None,
    district: str | None = None,
    ward: str | None = None,
    min_confidence: float = 0.0,
    bbox: tuple[float, float, float, float] | None = None,
    text: str | None = None,
) -> Column:
    """All conditions on active masters as one predicate: plain comparisons, which the scan can push down, come first."""
    given = [v is not None for v in (lat, lng, radius_m)]
    if any(given) and not all(given):
        raise ValueError("lat, lng and radius_m go together")
    if radius_m is not None and not 1 <= radius_m <= MAX_RADIUS_M:
        raise ValueError("radius_m out of bounds")
    tests = [F.col("status") == "active", F.col("confidence") >= min_confidence]
    if category is not None:
        tests.append((F.col("openooh_category") == category) | (F.col("openooh_subcategory") == category))
    for column, value in (("brand", brand), ("province_code", province), ("district_code", district), ("ward_code", ward)):
        if value is not None:
            tests.append(F.col(column) == value)
    if bbox is not None:
        tests.append(in_bbox(F.col("lat"), F.col("lng"), *bbox))
    if text:
        tests += [F.col("canonical_name").ilike(f"%{t}%") | F.col("canonical_address").ilike(f"%{t}%") for t in text.split()[:TOKENS]]
    if lat is not None:
        tests.append(within_radius(F.col("lat"), F.col("lng"), lat, lng, radius_m))
    return reduce(lambda a, b: a & b, tests)


def page(found: DataFrame, number: int = 1, per_page: int = PAGE) -> DataFrame:
    """One page, best first: confidence, then the latest change, then id; a top-k, not a full sort."""
    if not 1 <= per_page <= MAX_PAGE or number < 1:
        raise ValueError("page out of bounds")
    return found.orderBy(F.desc("confidence"), F.desc("updated_at"), "id").offset((number - 1) * per_page).limit(per_page)


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def with_distance(found: DataFrame, lat: float, lng: float) -> DataFrame:
    return found.withColumn("distance_m", geodesic_m(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")))


def get_poi(masters: DataFrame, poi_id) -> DataFrame:
    """By id, whatever the status."""
    return masters.filter(F.col("id") == poi_id)


def sources_lineage(masters: DataFrame) -> DataFrame:
    """One row for each source reference of a master."""
    return masters.select("id", F.posexplode("source_refs").alias("pos", "ref")).select("id", "pos", "ref.source", "ref.source_poi_id", "ref.raw_poi_id")


def history_of(history: DataFrame, poi_id) -> DataFrame:
    return history.filter(F.col("master_poi_id") == poi_id).orderBy("version", "changed_at")


def history_with_names(history: DataFrame, masters: DataFrame) -> DataFrame:
    """Audit rows with the present name of their master, if it is still there."""
    return history.join(masters.select(F.col("id").alias("_id"), "canonical_name"), history["master_poi_id"] == F.col("_id"), "left").drop("_id")


def brand_summary(masters: DataFrame, limit: int | None = None, top: int = 3) -> DataFrame:
    """Active masters by brand: count, mean confidence, first subcategory, ids of the three most confident.

    The three are found by a ranking with a limit, which Spark also applies before the shuffle, so no brand's ids are
    gathered, however large it is.
    """
    rows = masters.filter((F.col("status") == "active") & F.col("brand").isNotNull())
    counts = rows.groupBy("brand").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), F.min("openooh_subcategory").alias("category"))
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("confidence"), "id"))
    best = rows.select("brand", "id", "confidence").withColumn("r", rank).filter(F.col("r") <= top)
    ids = best.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t")).select("brand", F.transform("t", lambda x: x["id"]).alias("sample_ids"))
    out = counts.join(ids, "brand").orderBy(F.desc("n"), "brand")
    return out.limit(limit) if limit else out


def category_counts(masters: DataFrame) -> DataFrame:
    key = F.coalesce("openooh_subcategory", "openooh_category", F.lit("(none)"))
    return masters.filter("status = 'active'").groupBy(key.alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def brand_counts(masters: DataFrame) -> DataFrame:
    return masters.filter("status = 'active' AND brand IS NOT NULL").groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand")


def brand_totals(counts: DataFrame) -> DataFrame:
    """Number of brands, places with one, the largest brand."""
    return counts.agg(F.count("*").alias("brands"), F.sum("n").alias("places"), F.max_by("brand", F.struct("n", F.col("brand"))).alias("largest"))


def raw_filter(source: str | None = None, job_id: int | None = None, processed: bool | None = None, has_location: bool | None = None, since=None, bbox: tuple[float, float, float, float] | None = None) -> Column:
    """Predicate over bronze rows joined with their source's code."""
    tests = [F.lit(True)]
    if source is not None:
        tests.append(F.col("source_code") == source)
    if job_id is not None:
        tests.append(F.col("ingestion_job_id") == job_id)
    if processed is not None:
        tests.append(F.col("processed_at").isNotNull() if processed else F.col("processed_at").isNull())
    if has_location is not None:
        tests.append(F.col("lat").isNotNull() if has_location else F.col("lat").isNull())
    if since is not None:
        tests.append(F.col("fetched_at") >= F.lit(since))
    if bbox is not None:
        tests.append(in_bbox(F.col("lat"), F.col("lng"), *bbox))
    return reduce(lambda a, b: a & b, tests)


def list_raw(raw: DataFrame, sources: DataFrame, where: Column, number: int = 1, per_page: int = PAGE) -> DataFrame:
    """Newest bronze rows of a filter, with the source's code."""
    joined = raw.join(F.broadcast(sources.select(F.col("id").alias("source_id"), F.col("code").alias("source_code"))), "source_id")
    return joined.filter(where).orderBy(F.desc("fetched_at"), F.desc("id")).offset((number - 1) * per_page).limit(per_page)


def payload_preview(payload: Column) -> tuple[Column, Column]:
    """Name and address (first 120 characters) of any source's payload."""
    at = lambda p: F.get_json_object(payload, p)
    name = F.coalesce(at("$.displayName.text"), at("$.title"), at("$.tags.name"), at("$.name"))
    address = F.coalesce(at("$.formattedAddress"), at("$.address"), at("$.tags['addr:street']"))
    return name, F.substring(address, 1, 120)


def may(permissions: Column, wanted: str) -> Column:
    """Whether an API client may do something: the permission itself or the star."""
    return F.array_contains(permissions, wanted) | F.array_contains(permissions, "*")


def access(known: Column, permissions: Column, wanted: str) -> Column:
    """HTTP status of a request: 401 without a known and enabled client, 403 without the permission, else 200."""
    return F.when(~F.coalesce(known, F.lit(False)), 401).when(~F.coalesce(may(permissions, wanted), F.lit(False)), 403).otherwise(200)
