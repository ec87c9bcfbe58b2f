"""A fetcher without a network: one made-up place at the centre of each tile. For trials and tests."""

from __future__ import annotations

from collections.abc import Iterator


def fetch(lat: float, lng: float, radius_m: int, category: str | None) -> Iterator[tuple]:
    yield f"{category}-{lat}-{lng}", {"displayName": {"text": "Sample"}, "location": {"latitude": lat, "longitude": lng}, "radius": radius_m}, lat, lng


def fetch_by_id(source_poi_id: str) -> tuple | None:
    """The place of an id that `fetch` made; None for any other."""
    parts = source_poi_id.rsplit("-", 2)
    try:
        lat, lng = float(parts[1]), float(parts[2])
    except (IndexError, ValueError):
        return None
    return source_poi_id, {"displayName": {"text": "Sample"}}, lat, lng


def health_check() -> bool:
    return True
