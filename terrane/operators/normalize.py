"""Bronze to silver: address, brand, category, administrative units, quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import fixed_values as fixed
from terrane.functions.refdata import SOURCES, UNKNOWN_RELIABILITY, brands, listed, rows
from terrane.functions.text import blank_to_null, extract_domain, fold_ascii, name_normalized, normalize_text, phone_e164

# Prefixes of address parts, tried in this order; a prefix that leaves nothing falls through.
ADDRESS_PREFIXES = (
    (r"^t[hỉ]nh\b\.?\s*", "province"),
    (r"^tp\.?\s*hcm$", "hcm"),
    (r"^tp\.?\s*", "province"),
    (r"^th[àa]nh\s*ph[ốo]\b\.?\s*", "province"),
    (r"^qu[ậa]n\b\.?\s*", "district"),
    (r"^q\.?\s*\d+$", "district"),
    (r"^q\.\s*", "district"),
    (r"^huy[ệe]n\b\.?\s*", "district"),
    (r"^h\.\s*", "district"),
    (r"^th[ịi]\s*x[ãa]\b\.?\s*", "district"),
    (r"^ph[ưu][ờơ]ng\b\.?\s*", "ward"),
    (r"^p\.?\s*\d+$", "ward"),
    (r"^p\.\s*", "ward"),
    (r"^x[ãa]\b\.?\s*", "ward"),
    (r"^th[ịi]\s*tr[ấâ]n\b\.?\s*", "ward"),
)
COUNTRY_NAMES = ("việt nam", "viet nam", "vietnam", "vn")
HOUSE_NUMBER = r"(?iU)^\s*(\d+[a-z]?(?:[-/]\d+[a-z]?)?)\s+(.*)$"
ADDRESS_WEIGHTS = (("house_number", 0.05), ("street", 0.20), ("ward", 0.20), ("district", 0.25), ("province", 0.25), ("country", 0.05))
QUALITY_WEIGHTS = (("completeness", 0.25), ("freshness", 0.10), ("source_reliability", 0.15), ("address_confidence", 0.20), ("phone_valid", 0.10), ("has_coordinates", 0.20))
HALF_LIFE_DAYS = 180.0

_PARTS = "struct<country:string,province:string,district:string,ward:string,unknown:array<string>>"


def _label(token: Column) -> Column:
    """(label, value) by the first prefix that leaves something; null where none does."""
    tried = []
    for pattern, label in ADDRESS_PREFIXES:
        java = "(?iU)" + pattern
        left = F.lit("Hồ Chí Minh") if label == "hcm" else F.trim(F.regexp_replace(token, java, ""))
        tried.append(F.when(token.rlike(java) & (left != ""), F.struct(F.lit("province" if label == "hcm" else label).alias("label"), left.alias("value"))))
    return F.coalesce(*tried)


def parse_address(address: Column) -> Column:
    """Struct of house_number, street, ward, district, province, country, confidence, normalized.

    Later prefixed parts overwrite earlier ones; a bare province name counts while none is known; what is left over is
    street (with its house number), then ward, district and province where they are missing.
    """
    cleaned = F.regexp_replace(F.trim(F.coalesce(address, F.lit(""))), r"(?U)\s+", " ")
    tokens = F.filter(F.transform(F.split(cleaned, ","), lambda t: F.trim(t)), lambda t: t != "")
    judged = F.transform(
        tokens,
        lambda t: F.struct(
            t.alias("token"),
            normalize_text(t).isin(*COUNTRY_NAMES).alias("country"),
            _label(t).alias("prefix"),
            normalize_text(t).isin(*[r[0] for r in rows(fixed.PROVINCE_NAMES, 1)]).alias("named"),
        ),
    )

    def take(state: Column, t: Column) -> Column:
        label = F.when(t["country"], "country").when(t["prefix"].isNotNull(), t["prefix"]["label"]).when(t["named"] & state["province"].isNull(), "province")
        value = F.when(t["country"], "Việt Nam").when(t["prefix"].isNotNull(), t["prefix"]["value"]).otherwise(t["token"])
        put = lambda name: F.when(label == name, value).otherwise(state[name]).alias(name)
        return F.struct(put("country"), put("province"), put("district"), put("ward"), F.when(label.isNull(), F.array_append(state["unknown"], t["token"])).otherwise(state["unknown"]).alias("unknown"))

    empty = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("country", "province", "district", "ward")], F.array().cast("array<string>").alias("unknown"))

    def finish(state: Column) -> Column:
        head = F.get(state["unknown"], F.lit(0))
        numbered = head.rlike(HOUSE_NUMBER)
        street = F.when(numbered, F.trim(F.regexp_extract(head, HOUSE_NUMBER, 2))).otherwise(head)
        # Places among the leftovers that ward, district and province take.
        no_ward, no_district = state["ward"].isNull().cast("int"), state["district"].isNull().cast("int")
        ward = F.coalesce(state["ward"], F.get(state["unknown"], F.lit(1)))
        district = F.coalesce(state["district"], F.get(state["unknown"], 1 + no_ward))
        province = F.coalesce(state["province"], F.get(state["unknown"], 1 + no_ward + no_district))
        house = F.when(numbered, F.regexp_extract(head, HOUSE_NUMBER, 1))
        return F.struct(house.alias("house_number"), street.alias("street"), ward.alias("ward"), district.alias("district"), province.alias("province"), state["country"].alias("country"))

    parts = F.aggregate(judged, empty.cast(_PARTS), take, finish)

    def render(p: Column) -> Column:
        starts = lambda c, *heads: F.lower(c).rlike("^(?:" + "|".join(h.replace(".", r"\.") for h in heads) + ")")
        head = F.concat_ws(" ", F.nullif(p["house_number"], F.lit("")), F.nullif(p["street"], F.lit("")))
        ward = F.when(starts(p["ward"], "phường", "p."), p["ward"]).otherwise(F.concat(F.lit("Phường "), p["ward"]))
        district = F.when(starts(p["district"], "quận", "q.", "huyện", "h."), p["district"]).otherwise(F.concat(F.lit("Quận "), p["district"]))
        score = sum((F.when(p[c] != "", w).otherwise(0.0) for c, w in ADDRESS_WEIGHTS), F.lit(0.0))
        text = F.concat_ws(", ", F.nullif(head, F.lit("")), ward, district, p["province"], p["country"])
        return F.struct(*[p[c].alias(c) for c, _ in ADDRESS_WEIGHTS], F.round(F.least(score, F.lit(1.0)), 2).alias("confidence"), F.when(F.size(tokens) == 0, cleaned).otherwise(text).alias("normalized"))

    return F.get(F.transform(F.array(parts), render), F.lit(0))


#: Brands (with join_brands: patterns) that a plan holds as constants.
MAX_BRANDS = 5000


def brand_rows(table: DataFrame) -> list[tuple[str, list[str], str | None]]:
    """Enabled brands in order, as the plan's constants; the table is a dimension of a checked size."""
    found = table.filter("enabled").orderBy("ord").select("name", "aliases", "match_pattern").limit(MAX_BRANDS + 1).collect()
    if len(found) > MAX_BRANDS:
        raise ValueError(f"more than {MAX_BRANDS} brands: use join_brands")
    return [(r[0], r[1] or [], r[2]) for r in found]


def detect_brand(name: Column, known: list[tuple[str, list[str], str | None]]) -> Column:
    """Struct of brand and confidence: the first pattern found in the raw name (0.95), else the first brand with an alias
    all of whose words are words of the folded name (0.9 if they are the name, 0.75 else), else nulls."""
    found = lambda b, c: F.struct(F.lit(b).alias("brand"), F.lit(c).cast("double").alias("confidence"))
    by_pattern = [F.when(name.rlike("(?iU)" + p), found(n, 0.95)) for n, _, p in known if p]
    catalogue = F.array(*[F.struct(F.lit(n).alias("name"), F.transform(F.array(*[F.lit(a) for a in dict.fromkeys([n, *al])]), lambda a: normalize_text(a)).alias("aliases")) for n, al, _ in known])

    def by_alias(folded: Column) -> Column:
        words = F.split(folded, " ")
        fits = lambda a: (a != "") & F.forall(F.split(a, " "), lambda w: (F.length(w) >= 2) & F.array_contains(words, w))
        first = F.get(F.filter(catalogue, lambda b: F.exists(b["aliases"], fits)), F.lit(0))
        sure = F.exists(first["aliases"], lambda a: fits(a) & (a == folded))
        return F.when(first.isNotNull(), F.struct(first["name"].alias("brand"), F.when(sure, 0.9).otherwise(0.75).alias("confidence")))

    alias = F.get(F.transform(F.array(normalize_text(name)), by_alias), F.lit(0))
    return F.coalesce(*by_pattern, alias, F.struct(F.lit(None).cast("string").alias("brand"), F.lit(None).cast("double").alias("confidence")))


def join_brands(named: DataFrame, table: DataFrame, name: str = "name", out: str = "_brand") -> DataFrame:
    """named with the struct of detect_brand, for any number of brands.

    Each alias is met at its rarest word, by a join with the words of the different folded names, and checked whole; of the
    brands found the first counts. Only patterns are constants of the plan.
    """
    alone = F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias")
    folded = table.filter("enabled").select("ord", F.col("name").alias("brand"), alone).withColumn("alias", normalize_text(F.col("alias"))).withColumn("parts", F.split("alias", " "))
    usable = folded.filter((F.col("alias") != "") & F.forall("parts", lambda w: F.length(w) >= 2)).distinct()
    words = usable.select("ord", "brand", "alias", "parts", F.explode(F.array_distinct("parts")).alias("word"))
    common = words.groupBy("word").agg(F.count("*").alias("n"))
    met = words.join(common, "word").groupBy("ord", "brand", "alias", "parts").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    names = named.select(normalize_text(F.col(name)).alias("_folded")).distinct().withColumn("_words", F.array_distinct(F.split("_folded", " ")))
    hits = names.withColumn("word", F.explode("_words")).join(met, "word").filter(F.size(F.array_except("parts", "_words")) == 0)
    first = hits.groupBy("_folded").agg(F.min(F.struct("ord", (F.col("alias") != F.col("_folded")).alias("part"), "brand")).alias("_first"))
    found = lambda b, c: F.struct(b.alias("brand"), c.cast("double").alias("confidence"))
    by_pattern = [F.when(F.col(name).rlike("(?iU)" + p), found(F.lit(b), F.lit(0.95))) for b, _, p in brand_rows(table.filter("match_pattern IS NOT NULL AND match_pattern <> ''"))]
    alias = F.when(F.col("_first").isNotNull(), found(F.col("_first.brand"), F.when(F.col("_first.part"), 0.75).otherwise(0.9)))
    joined = named.withColumn("_folded", normalize_text(F.col(name))).join(first, "_folded", "left")
    return joined.withColumn(out, F.coalesce(*by_pattern, alias, found(F.lit(None).cast("string"), F.lit(None)))).drop("_folded", "_first")


def _pair(top: str | None, sub: str | None) -> Column:
    return F.struct(F.lit(top).cast("string").alias("category"), F.lit(sub).cast("string").alias("subcategory"))


def _lookup(key: Column, table: str) -> Column:
    made = F.create_map(*[x for k, top, sub in rows(table, 3) for x in (F.lit(k), _pair(top, sub))])
    return F.try_element_at(made, key)


def _first_contained(folded: Column, table: str) -> Column:
    rules = F.array(*[F.struct(F.lit(k).alias("part"), _pair(top, sub).alias("pair")) for k, top, sub in rows(table, 3)])
    return F.get(F.transform(F.array(folded), lambda f: F.get(F.filter(rules, lambda r: F.contains(f, r["part"])), F.lit(0))["pair"]), F.lit(0))


def map_category(source: Column, raw: Column) -> Column:
    """(category, subcategory) of a source's own category; null where nothing is known."""
    osm = F.coalesce(_lookup(F.lower(raw), fixed.OSM_TAGS), F.when(F.lower(raw).startswith("office="), _pair("office_buildings", "office_buildings.office_towers")))
    return F.when(source == "google_places", _lookup(F.lower(raw), fixed.GOOGLE_TYPES)).when(source == "osm_overpass", osm).when(source == "gosom_scraper", _first_contained(normalize_text(raw), fixed.SCRAPER_LABELS))


def infer_category(name: Column) -> Column:
    """(category, subcategory) from words of the name; null where none fits."""
    return _first_contained(normalize_text(name), fixed.NAME_RULES)


def category(source: Column, raw: Column, name: Column) -> Column:
    """The source's category, or else what the name says; a pair is taken whole."""
    return F.coalesce(map_category(source, raw), infer_category(name), _pair(None, None))


def search_keywords(code: Column, scraper_default: bool = False) -> Column:
    """Search words of a category code: its own, those of its top level, or the default."""
    made = F.create_map(*[x for k, words in rows(fixed.KEYWORDS, 2) for x in (F.lit(k), F.array(*[F.lit(w) for w in listed(words)]))])
    clean = F.lower(F.trim(code))
    known = F.coalesce(F.try_element_at(made, clean), F.when(F.contains(clean, F.lit(".")), F.try_element_at(made, F.substring_index(clean, ".", 1))))
    if not scraper_default:
        return F.coalesce(known, F.array(*[F.lit(w) for w in fixed.DEFAULT_KEYWORDS]))
    none = F.array(*[F.lit(w) for w in ("restaurant", "cafe", "convenience store", "shop")])
    return F.when(F.coalesce(code, F.lit("")) == "", none).otherwise(F.coalesce(known, F.array(code)))


def is_category_code(code: Column) -> Column:
    codes = [r[0] for r in rows(fixed.KEYWORDS, 2)]
    clean = F.lower(F.trim(code))
    return F.coalesce(clean.isin(*codes) | (F.contains(clean, F.lit(".")) & F.substring_index(clean, ".", 1).isin(*codes)), F.lit(False))


def quality(source: Column, fetched_at: Column, as_of: Column, has: dict[str, Column], address_confidence: Column, phone_valid: Column) -> Column:
    """Struct of the six factors and score. `has`: name, address, phone, website, coordinates, category."""
    reliability = F.coalesce(F.try_element_at(F.create_map(*[x for s in SOURCES for x in (F.lit(s[1]), F.lit(s[4]))]), source), F.lit(UNKNOWN_RELIABILITY))
    age_days = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(fetched_at.cast("timestamp"))) / 86400e6)
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    factors = F.struct(
        F.round(sum((one(c) for c in has.values()), F.lit(0.0)) / 6, 3).alias("completeness"),
        F.round(F.pow(F.lit(0.5), age_days / HALF_LIFE_DAYS), 3).alias("freshness"),
        reliability.alias("source_reliability"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(address_confidence, F.lit(0.0)))), 3).alias("address_confidence"),
        one(phone_valid).alias("phone_valid"),
        one(has["coordinates"]).alias("has_coordinates"),
    )
    return F.get(F.transform(F.array(factors), lambda f: F.struct(f.alias("factors"), F.round(sum((f[c] * w for c, w in QUALITY_WEIGHTS), F.lit(0.0)), 3).alias("score"))), F.lit(0))


def stamp_admin(points: DataFrame, units: DataFrame, key: str = "id", cell: float = 0.5) -> DataFrame:
    """Add province_code, district_code, ward_code: of the units of a level whose box holds the point (borders too), the one
    of the smallest area. Units are spread over grid cells, so the join is on equal cells, whatever their number."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    boxes = units.select("code", "level", "lng_min", "lat_min", "lng_max", "lat_max", F.explode(span("lat_min", "lat_max")).alias("gy")).withColumn("gx", F.explode(span("lng_min", "lng_max")))
    placed = points.select(F.col(key).alias("_key"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.floor(F.col("lat") / cell).alias("gy"), F.floor(F.col("lng") / cell).alias("gx"))
    inside = placed.join(boxes, ["gy", "gx"]).filter("_lat BETWEEN lat_min AND lat_max AND _lng BETWEEN lng_min AND lng_max")
    area = F.struct((F.col("lng_max") - F.col("lng_min")) * (F.col("lat_max") - F.col("lat_min")), F.col("code"))
    best = inside.groupBy("_key").agg(*[F.min_by("code", F.when(F.col("level") == i, area)).alias(c) for i, c in ((1, "province_code"), (2, "district_code"), (3, "ward_code"))])
    return points.join(best, points[key] == best["_key"], "left").drop("_key")


def backfill_admin(silver: DataFrame, units: DataFrame, key: str = "id") -> DataFrame:
    """Silver where rows without a province have the three codes of their point; the others stay as they are and aren't joined."""
    codes = ("province_code", "district_code", "ward_code")
    stamped = stamp_admin(silver.filter("province_code IS NULL").drop(*codes), units, key)
    return silver.filter("province_code IS NOT NULL").unionByName(stamped)


def to_silver(raw: DataFrame, brand_table: DataFrame | None = None, units: DataFrame | None = None, as_of: dt.datetime | Column | None = None) -> DataFrame:
    """Silver rows of extracted bronze rows.

    `raw` has raw_poi_id, source_code, fetched_at and the canonical fields name, address, phone, website, raw_category, lat,
    lng, with raw_lat and raw_lng as the fallback. Rows without a name or any point give no silver row. A row placed by the
    fallback gets no administrative codes and counts as without coordinates, as the point isn't from the payload.
    """
    spark = raw.sparkSession
    now = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(as_of)
    known = (brand_table if brand_table is not None else brands(spark)).filter("enabled")
    many = known.limit(MAX_BRANDS + 1).count() > MAX_BRANDS
    own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    rows_ = raw.filter(blank_to_null(F.col("name")).isNotNull()).withColumn("_own", own)
    rows_ = rows_.withColumn("lat", F.when(own, F.col("lat")).otherwise(F.col("raw_lat"))).withColumn("lng", F.when(own, F.col("lng")).otherwise(F.col("raw_lng"))).filter("lat IS NOT NULL AND lng IS NOT NULL")
    rows_ = rows_.withColumn("_address", parse_address(F.col("address"))).withColumn("_phone", phone_e164(F.col("phone"))).withColumn("_category", category(F.col("source_code"), F.col("raw_category"), F.col("name")))
    rows_ = join_brands(rows_, known) if many else rows_.withColumn("_brand", detect_brand(F.col("name"), brand_rows(known)))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    has = {"name": filled("name"), "address": filled("address"), "phone": filled("phone"), "website": filled("website"), "coordinates": F.col("_own"), "category": F.col("_category.category").isNotNull()}
    rows_ = rows_.withColumn("_quality", quality(F.col("source_code"), F.col("fetched_at"), now, has, F.col("_address.confidence"), F.col("_phone").isNotNull()))
    silver = rows_.select(
        F.col("raw_poi_id").alias("id"),
        "raw_poi_id",
        "source_code",
        F.col("name").alias("name_original"),
        name_normalized(F.col("name")).alias("name_normalized"),
        F.col("address").alias("address_original"),
        F.col("_address.normalized").alias("address_normalized"),
        F.struct(*[F.col(f"_address.{c}") for c in (*[c for c, _ in ADDRESS_WEIGHTS], "confidence")]).alias("address_components"),
        F.col("phone").alias("phone_original"),
        F.col("_phone").alias("phone_e164"),
        "website",
        extract_domain(F.col("website")).alias("website_domain"),
        F.col("_category.category").alias("openooh_category"),
        F.col("_category.subcategory").alias("openooh_subcategory"),
        "raw_category",
        F.col("_brand.brand").alias("brand"),
        F.col("_brand.confidence").cast("decimal(3,2)").alias("brand_confidence"),
        "lat",
        "lng",
        "_own",
        F.col("_quality.score").cast("decimal(3,2)").alias("quality_score"),
        F.col("_quality.factors").alias("quality_factors"),
        F.lit("pending").alias("merge_status"),
    )
    if units is None:
        return silver.drop("_own")
    placed = stamp_admin(silver, units)
    codes = ("province_code", "district_code", "ward_code")
    return placed.select(*[c for c in placed.columns if c not in (*codes, "_own")], *[F.when(F.col("_own"), F.col(c)).alias(c) for c in codes])


__all__ = ["ADDRESS_PREFIXES", "category", "detect_brand", "fold_ascii", "infer_category", "is_category_code", "map_category", "parse_address", "quality", "search_keywords", "stamp_admin", "to_silver"]
