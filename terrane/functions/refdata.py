"""Reference tables as small DataFrames, read from the fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fixed_values as fixed

#: Source code, name, priority (lower: more trusted), reliability. Fixed values.
SOURCES = (
    (1, "google_places", "Google Places", 10, 0.90),
    (2, "vietmap", "Vietmap Maps API", 15, 0.80),
    (3, "osm_overpass", "OpenStreetMap (Overpass API)", 20, 0.70),
    (4, "gosom_scraper", "Maps scraper", 30, 0.75),
    (5, "foody", "Foody.vn", 40, 0.65),
)
UNKNOWN_PRIORITY, UNKNOWN_RELIABILITY = 1000, 0.5


def rows(table: str, columns: int) -> list[list[str | None]]:
    """Rows of a fixed table; empty cells are null; the last column keeps its bars."""
    return [[c or None for c in line.split("|", columns - 1)] for line in table.strip("\n").split("\n")]


def listed(text: str | None) -> list[str]:
    return text.split(";") if text else []


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "id int, code string, name string, priority int, reliability double")


def brands(spark: SparkSession) -> DataFrame:
    """ord (first match wins), name, aliases, category, parent_company, match_pattern, enabled."""
    data = [(i, r[0], listed(r[1]), r[2], r[3], r[4], True) for i, r in enumerate(rows(fixed.BRANDS, 5))]
    return spark.createDataFrame(data, "ord int, name string, aliases array<string>, category string, parent_company string, match_pattern string, enabled boolean")


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0], r[1], r[2], int(r[3])) for r in rows(fixed.TAXONOMY, 4)], "code string, name string, parent_code string, level int")


def admin_units(spark: SparkSession) -> DataFrame:
    data = [(r[0], r[1], r[2], int(r[3]), *map(float, r[4:])) for r in rows(fixed.ADMIN_UNITS, 8)]
    return spark.createDataFrame(data, "code string, name string, parent_code string, level int, lng_min double, lat_min double, lng_max double, lat_max double")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0], r[1], r[2], listed(r[3])) for r in rows(fixed.REGIONS, 4)], "code string, name string, short_name string, province_codes array<string>")


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0], listed(r[1])) for r in rows(fixed.KEYWORDS, 2)], "code string, words array<string>")


def priorities(spark: SparkSession) -> DataFrame:
    """code, priority: tiers start at 10, 200 and 500."""
    data = [(code, start + i) for start, tier in ((10, fixed.TIER_1), (200, fixed.TIER_2), (500, fixed.TIER_3)) for i, (code,) in enumerate(rows(tier, 1))]
    return spark.createDataFrame(data, "code string, priority int")
