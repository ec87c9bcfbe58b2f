"""Spatial layout of tables: rows in the order of interleaved bits of their coordinates, so that a box reads few files.

Rows are range-partitioned and sorted by the interleaved bits (a Z-order), and a small table of files keeps the range of each. A
box is covered by a bounded number of ranges; only files that meet one are opened, and in those only row groups whose statistics do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.geo import in_bbox, within_radius

#: Bits of each coordinate: cells of about two metres. Ranges that cover a box at most.
BITS, MOST_RANGES = 24, 64
#: Name of the column, which readers of a layout don't see.
Z = "z_order"
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _step(value: Column, low: float, high: float) -> Column:
    """A coordinate as an integer of BITS bits, the last cell holding the upper border; the same as _cell."""
    return F.least(F.greatest(F.floor((value - low) / (high - low) * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def _cell(value: float, low: float, high: float) -> int:
    return min(max(math.floor((value - low) / (high - low) * (1 << BITS)), 0), (1 << BITS) - 1)


def _spread(value: Column) -> Column:
    for shift, mask in _SPREAD:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def z_value(lat: Column, lng: Column) -> Column:
    """Bits of latitude and longitude, interleaved; null where one is missing."""
    return F.shiftleft(_spread(_step(lat, -90.0, 90.0)), 1).bitwiseOR(_spread(_step(lng, -180.0, 180.0)))


def z_ranges(west: float, south: float, east: float, north: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of z (both ends inclusive) that hold every point of a box: quarters are split, largest first, while they cross its border
    and there are fewer than `most`; neighbours are joined."""
    x0, x1, y0, y1 = _cell(west, -180.0, 180.0), _cell(east, -180.0, 180.0), _cell(south, -90.0, 90.0), _cell(north, -90.0, 90.0)
    inside: list[tuple[int, int, int]] = []
    open_ = [(0, 0, BITS)]  # corner and level of squares that cross the border
    while open_ and len(open_) + len(inside) < most:
        x, y, level = open_.pop(0)
        if level == 0:
            inside.append((x, y, 0))
            continue
        half = 1 << (level - 1)
        for cx, cy in ((x, y), (x + half, y), (x, y + half), (x + half, y + half)):
            if cx + half - 1 < x0 or cx > x1 or cy + half - 1 < y0 or cy > y1:
                continue
            within = x0 <= cx and cx + half - 1 <= x1 and y0 <= cy and cy + half - 1 <= y1
            (inside if within else open_).append((cx, cy, level - 1))
    out: list[tuple[int, int]] = []
    for low, high in sorted((_z(x, y), _z(x, y) + (1 << 2 * level) - 1) for x, y, level in (*inside, *open_)):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _z(x: int, y: int) -> int:
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(BITS))


def write_layout(df: DataFrame, path: str, files: int) -> None:
    """Write df (with lat and lng) as about `files` files in Z-order, and the table of their ranges beside them. Rows without a
    point are in the first file and in no box."""
    ordered = df.withColumn(Z, z_value(F.col("lat"), F.col("lng"))).repartitionByRange(files, Z).sortWithinPartitions(Z)
    ordered.write.parquet(f"{path}/rows")
    held = df.sparkSession.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(Z).alias("low"), F.max(Z).alias("high"), F.count("*").alias("rows"))
    held.coalesce(1).write.parquet(f"{path}/files")


def _among(ranges: list[tuple[int, int]], low: Column, high: Column) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((high >= a) & (low <= b))
    return out


def files_of_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """file, rows of the files that may hold points of a box."""
    return spark.read.parquet(f"{path}/files").filter(_among(z_ranges(west, south, east, north), F.col("low"), F.col("high"))).select("file", "rows")


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """The rows strictly inside a box, from the files and row groups that may hold some."""
    found = [r["file"] for r in files_of_box(spark, path, west, south, east, north).collect()]  # as many as the box needs
    rows = spark.read.parquet(*found) if found else spark.read.parquet(f"{path}/rows").limit(0)
    z = F.col(Z)
    return rows.filter(_among(z_ranges(west, south, east, north), z, z)).filter(in_bbox(F.col("lat"), F.col("lng"), west, south, east, north)).drop(Z)


def read_radius(spark: SparkSession, path: str, lat: float, lng: float, radius_m: float) -> DataFrame:
    """The rows at most radius_m from a point."""
    d_lat = radius_m / 110000.0
    d_lng = radius_m / (110000.0 * max(math.cos(math.radians(min(89.0, abs(lat) + d_lat))), 0.01))
    near = read_box(spark, path, lng - d_lng, lat - d_lat, lng + d_lng, lat + d_lat)
    return near.filter(within_radius(F.col("lat"), F.col("lng"), lat, lng, radius_m))
