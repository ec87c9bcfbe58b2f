"""Sources: payloads of places to bronze records and canonical fields. Bodies are landed JSON or CSV; no network is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import blank_to_null

SCRAPER_COLUMNS = "input_id string, link string, title string, category string, address string, phone string, website string, latitude string, longitude string, review_count string, review_rating string, data_id string, place_id string"
OSM_KEYS = ("amenity", "shop", "tourism", "office", "leisure")
#: Request of the nearby search. Fixed values.
NEARBY_LIMIT, LANGUAGE = 20, "vi"


def _json(path: str, column: str = "raw_payload") -> Column:
    return F.get_json_object(column, path)


def _some(*columns: Column) -> Column:
    """First that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def read_landing(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Landed bodies as raw_payload (JSON text): 'jsonl' one place a line, 'scraper_csv' a header and all-string columns."""
    if kind == "jsonl":
        return spark.read.text(path).withColumnRenamed("value", "raw_payload")
    if kind == "scraper_csv":
        table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(SCRAPER_COLUMNS).csv(path)
        return table.select(F.to_json(F.struct(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in table.columns])).alias("raw_payload"))
    raise KeyError(kind)


def nearby_request(lat: float, lng: float, radius_m: int, category: str | None = None) -> dict:
    """Body of a nearby search: a circle, at most 20 results."""
    body: dict = {"maxResultCount": NEARBY_LIMIT, "languageCode": LANGUAGE, "locationRestriction": {"circle": {"center": {"latitude": lat, "longitude": lng}, "radius": float(radius_m)}}}
    if category:
        body["includedTypes"] = [category]
    return body


def overpass_query(lat: float, lng: float, radius_m: int, category: str | None = None, timeout: int = 180) -> str:
    """Union of nodes, ways and relations around a point: 'key=value' asks for one tag, another word for that value of any key."""
    key, equals, value = (category or "").partition("=")
    filters = [f'["{key}"="{value}"]'] if equals else [f'["{k}"="{category}"]' if category else f'["{k}"]' for k in OSM_KEYS]
    lines = [f"  {element}{tag}(around:{radius_m},{lat},{lng});" for element in ("node", "way", "relation") for tag in filters]
    return "\n".join([f"[out:json][timeout:{timeout}];", "(", *lines, ");", "out center tags;"])


def zoom_for_radius(radius_m: Column) -> Column:
    return F.when(radius_m <= 600, 16).when(radius_m <= 1500, 15).when(radius_m <= 4000, 14).when(radius_m <= 10000, 13).otherwise(12)


def google_records(payloads: DataFrame) -> DataFrame:
    """source_poi_id, raw_payload, lat, lng; a place without an id is dropped."""
    return payloads.select(_some(_json("$.id")).alias("source_poi_id"), "raw_payload", _json("$.location.latitude").cast("double").alias("lat"), _json("$.location.longitude").cast("double").alias("lng")).filter("source_poi_id IS NOT NULL")


def osm_records(payloads: DataFrame) -> DataFrame:
    """Ids osm-type-id; nodes carry their point, ways and relations a centre; other kinds are dropped."""
    kind = _json("$.type")
    at = lambda c: F.when(kind == "node", _json(f"$.{c}")).otherwise(_json(f"$.center.{c}")).cast("double")
    return payloads.filter(kind.isin("node", "way", "relation") & _json("$.id").isNotNull()).select(F.concat_ws("-", F.lit("osm"), kind, _json("$.id")).alias("source_poi_id"), "raw_payload", at("lat").alias("lat"), at("lon").alias("lng"))


def osm_id_parts(source_poi_id: Column) -> Column:
    """Kind and number of an id osm-kind-number; anything else is an error."""
    pattern = r"^osm-(node|way|relation)-([0-9]+)$"
    return F.when(source_poi_id.rlike(pattern), F.struct(F.regexp_extract(source_poi_id, pattern, 1).alias("kind"), F.regexp_extract(source_poi_id, pattern, 2).cast("long").alias("number"))).otherwise(
        F.raise_error(F.concat(F.lit("not an OSM id: "), source_poi_id)).cast("struct<kind:string,number:bigint>")
    )


def scraper_records(payloads: DataFrame) -> DataFrame:
    """The place or data id, else a stable hash of the link or title; rows with none are dropped; bad coordinates are null."""
    link = _some(_json("$.link"), _json("$.title"))
    made = F.when(link.isNotNull(), F.concat(F.lit("gosom-"), F.lower(F.hex(F.xxhash64(link)))))
    number = lambda c: F.expr(f"try_cast(nullif(trim(get_json_object(raw_payload, '$.{c}')), '') AS double)")
    lat, lng = number("latitude"), number("longitude")
    both = lat.isNotNull() & lng.isNotNull()
    return payloads.select(F.coalesce(_some(_json("$.place_id"), _json("$.data_id")), made).alias("source_poi_id"), "raw_payload", F.when(both, lat).alias("lat"), F.when(both, lng).alias("lng")).filter("source_poi_id IS NOT NULL")


def osm_address(tag: Callable[[str], Column]) -> Column:
    """Address composed of the addr tags, in Vietnamese order."""
    parts = [tag("addr:housenumber"), tag("addr:street"), _some(tag("addr:subdistrict"), tag("addr:hamlet")), tag("addr:district"), _some(tag("addr:city"), tag("addr:province")), tag("addr:country")]
    return F.nullif(F.concat_ws(", ", *[F.trim(F.nullif(p, F.lit(""))) for p in parts]), F.lit(""))


def _extract_google() -> dict[str, Column]:
    return {
        "name": blank_to_null(_json("$.displayName.text")),
        "lat": _json("$.location.latitude").cast("double"),
        "lng": _json("$.location.longitude").cast("double"),
        "address": blank_to_null(_json("$.formattedAddress")),
        "phone": blank_to_null(_some(_json("$.nationalPhoneNumber"), _json("$.internationalPhoneNumber"))),
        "website": blank_to_null(_json("$.websiteUri")),
        "raw_category": _some(_json("$.primaryType"), _json("$.types[0]")),
    }


def _extract_osm() -> dict[str, Column]:
    tag = lambda k: _json(f"$.tags['{k}']")
    at = lambda c: F.when(_json("$.type") == "node", _json(f"$.{c}")).otherwise(_json(f"$.center.{c}")).cast("double")
    return {
        "name": blank_to_null(_some(tag("name:vi"), tag("name"), tag("name:en"))),
        "lat": at("lat"),
        "lng": at("lon"),
        "address": osm_address(tag),
        "phone": blank_to_null(_some(tag("phone"), tag("contact:phone"))),
        "website": blank_to_null(_some(tag("website"), tag("contact:website"), tag("url"))),
        "raw_category": F.coalesce(*[F.when(tag(k).isNotNull(), F.concat(F.lit(f"{k}="), tag(k))) for k in OSM_KEYS]),
    }


def _extract_scraper() -> dict[str, Column]:
    cell = lambda k: blank_to_null(_json(f"$.{k}"))
    number = lambda k: F.expr(f"try_cast(nullif(trim(get_json_object(raw_payload, '$.{k}')), '') AS double)")
    both = number("latitude").isNotNull() & number("longitude").isNotNull()
    return {"name": cell("title"), "lat": F.when(both, number("latitude")), "lng": F.when(both, number("longitude")), "address": cell("address"), "phone": cell("phone"), "website": cell("website"), "raw_category": cell("category")}


#: Readers of payloads and extractors of canonical fields by source code; both can be added to.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"google_places": google_records, "osm_overpass": osm_records, "gosom_scraper": scraper_records}
EXTRACTORS: dict[str, Callable[[], dict[str, Column]]] = {"google_places": _extract_google, "osm_overpass": _extract_osm, "gosom_scraper": _extract_scraper}
FIELDS = ("name", "lat", "lng", "address", "phone", "website", "raw_category")


def register_extractor(source_code: str, make: Callable[[], dict[str, Column]]) -> None:
    EXTRACTORS[source_code] = make


def register_adapter(source_code: str, read: Callable[[DataFrame], DataFrame]) -> None:
    ADAPTERS[source_code] = read


def extract(raw: DataFrame) -> DataFrame:
    """Add the canonical fields, by the source of each row, in one projection; rows of unknown sources are left out (they
    stay unprocessed)."""
    made = {code: make() for code, make in EXTRACTORS.items()}
    columns = []
    for field in FIELDS:
        picked = None
        for code, fields in made.items():
            test = F.col("source_code") == code
            picked = F.when(test, fields[field]) if picked is None else picked.when(test, fields[field])
        columns.append(picked.alias(field))
    keep = [F.col(c).alias(f"raw_{c}") if c in ("lat", "lng") else F.col(c) for c in raw.columns]
    return raw.filter(F.col("source_code").isin(*made)).select(*keep, *columns)
