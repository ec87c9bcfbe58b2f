"""Geometry on columns: everything stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84 ellipsoid and the sphere of Web Mercator. Fixed values.
A, FLATTENING, MERCATOR_R = 6378137.0, 1 / 298.257223563, 6378137.0
B = A * (1 - FLATTENING)
#: Rounds of the inverse problem; five leave less than a millimetre at city and country distances.
ROUNDS = 6


def _let(value: Column, body) -> Column:
    """Name a value inside an expression, so it is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def geodesic_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on the WGS 84 ellipsoid (the inverse problem by fixed-point rounds; nearly antipodal points excepted)."""
    d = F.radians(lng2 - lng1)
    u1, u2 = F.atan((1 - FLATTENING) * F.tan(F.radians(lat1))), F.atan((1 - FLATTENING) * F.tan(F.radians(lat2)))

    def solve(p: Column) -> Column:
        s1, c1, s2, c2, dl = p["s1"], p["c1"], p["s2"], p["c2"], p["d"]

        def state(lam: Column) -> Column:
            sin_s = F.sqrt((c2 * F.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * F.cos(lam)) ** 2)
            cos_s = s1 * s2 + c1 * c2 * F.cos(lam)
            return _let(
                F.struct(sin_s.alias("ss"), cos_s.alias("cs"), lam.alias("lam")),
                lambda q: _let(
                    F.struct(q["ss"].alias("ss"), q["cs"].alias("cs"), F.when(q["ss"] == 0, F.lit(0.0)).otherwise(c1 * c2 * F.sin(q["lam"]) / q["ss"]).alias("sa")),
                    lambda r: F.struct(
                        r["ss"].alias("ss"),
                        r["cs"].alias("cs"),
                        r["sa"].alias("sa"),
                        F.atan2(r["ss"], r["cs"]).alias("sig"),
                        (1 - r["sa"] * r["sa"]).alias("c2a"),
                        F.when(1 - r["sa"] * r["sa"] == 0, F.lit(0.0)).otherwise(r["cs"] - 2 * s1 * s2 / (1 - r["sa"] * r["sa"])).alias("cm"),
                    ),
                ),
            )

        def step(lam: Column, _: Column) -> Column:
            def following(q: Column) -> Column:
                c = FLATTENING / 16 * q["c2a"] * (4 + FLATTENING * (4 - 3 * q["c2a"]))
                return dl + (1 - c) * FLATTENING * q["sa"] * (q["sig"] + c * q["ss"] * (q["cm"] + c * q["cs"] * (2 * q["cm"] * q["cm"] - 1)))

            return _let(state(lam), following)

        def length(q: Column) -> Column:
            usq = q["c2a"] * ((A * A - B * B) / (B * B))
            big_a = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
            big_b = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
            cm2 = q["cm"] * q["cm"]
            return B * big_a * (q["sig"] - big_b * q["ss"] * (q["cm"] + big_b / 4 * (q["cs"] * (2 * cm2 - 1) - big_b / 6 * q["cm"] * (4 * q["ss"] * q["ss"] - 3) * (4 * cm2 - 3))))

        lam = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), dl, step)
        return _let(lam, lambda found: _let(state(found), length))

    return _let(F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), d.alias("d")), solve)


def within_radius(lat: Column, lng: Column, lat0: float, lng0: float, radius_m: float) -> Column:
    """Inclusive radius filter: a box that the scan can prune by, then the geodesic distance."""
    d_lat = radius_m / 110000.0
    d_lng = radius_m / (110000.0 * max(math.cos(math.radians(min(89.0, abs(lat0) + d_lat))), 0.01))
    box = lat.between(lat0 - d_lat, lat0 + d_lat) & lng.between(lng0 - d_lng, lng0 + d_lng)
    return box & (geodesic_m(F.lit(lat0), F.lit(lng0), lat, lng) <= radius_m)


def in_bbox(lat: Column, lng: Column, west: float, south: float, east: float, north: float) -> Column:
    """Strictly inside: a point on the border is outside."""
    return (lng > west) & (lng < east) & (lat > south) & (lat < north)


def mercator_x(lng: Column) -> Column:
    return MERCATOR_R * F.radians(lng)


def mercator_y(lat: Column) -> Column:
    return MERCATOR_R * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def tile_centers(west: Column, south: Column, east: Column, north: Column, cell_m: Column) -> Column:
    """Array of (lat, lng) centres of a grid over a box, by rows of latitude; an inverted box is an error."""
    cell_lat = cell_m / 111000.0
    cell_lng = cell_m / (111000.0 * F.greatest(F.cos(F.radians((south + north) / 2)), F.lit(0.05)))
    n_lat = F.greatest(F.lit(1), F.ceil((north - south) / cell_lat).cast("int"))
    n_lng = F.greatest(F.lit(1), F.ceil((east - west) / cell_lng).cast("int"))
    centre = lambda low, high, n, i: F.round(low + (high - low) / n * (i + 0.5), 6)
    grid = F.flatten(
        F.transform(
            F.sequence(F.lit(0), n_lat - 1),
            lambda i: F.transform(F.sequence(F.lit(0), n_lng - 1), lambda j: F.struct(centre(south, north, n_lat, i).alias("lat"), centre(west, east, n_lng, j).alias("lng"))),
        )
    )
    return F.when((east > west) & (north > south), grid).otherwise(F.raise_error(F.lit("bbox is inverted")).cast("array<struct<lat:double,lng:double>>"))
