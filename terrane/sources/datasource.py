"""A Spark data source over place adapters: one partition for each tile, fetched on the executors.

`spark.dataSource.register(PlaceSource)` and then

    spark.read.format("places").option("fetcher", "module:function").option("west", ...).option("south", ...)
         .option("east", ...).option("north", ...).option("cell_m", 5000).option("category", "retail").load()

The fetcher is called with (lat, lng, radius_m, category) and yields (source_poi_id, payload, lat, lng); the payload may be
a mapping or JSON text. Details by id, scrape jobs and health checks are in `fetch`.
"""

from __future__ import annotations

import importlib
import json
import math
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ID_LENGTH = 255


def load_fetcher(name: str):
    """The function named 'module:function'."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def grid(west: float, south: float, east: float, north: float, cell_m: float) -> list[tuple[float, float]]:
    """Centres of the cells over a box, by rows of latitude: the driver's plan of a crawl, one entry for each partition."""
    if east <= west or north <= south:
        raise ValueError("bbox is inverted")
    n_lat = max(1, math.ceil((north - south) / (cell_m / 111000)))
    n_lng = max(1, math.ceil((east - west) / (cell_m / (111000 * max(math.cos(math.radians((south + north) / 2)), 0.05)))))
    return [(round(south + (north - south) / n_lat * (i + 0.5), 6), round(west + (east - west) / n_lng * (j + 0.5), 6)) for i in range(n_lat) for j in range(n_lng)]


class Tile(InputPartition):
    def __init__(self, lat: float, lng: float, radius_m: int) -> None:
        self.lat, self.lng, self.radius_m = lat, lng, radius_m


class PlaceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.fetcher, self.category = options["fetcher"], options.get("category")
        self.box = [float(options[k]) for k in ("west", "south", "east", "north")]
        self.cell_m = int(options.get("cell_m", "5000"))

    def partitions(self) -> list[Tile]:
        return [Tile(lat, lng, self.cell_m // 2) for lat, lng in grid(*self.box, self.cell_m)]

    def read(self, partition: Tile) -> Iterator[tuple]:
        for poi_id, payload, lat, lng in load_fetcher(self.fetcher)(partition.lat, partition.lng, partition.radius_m, self.category):
            if poi_id and len(str(poi_id)) <= ID_LENGTH:
                yield str(poi_id), payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False), lat, lng


class PlaceSource(DataSource):
    """Places of an area, by tiles."""

    @classmethod
    def name(cls) -> str:
        return "places"

    def schema(self) -> str:
        return "source_poi_id string, raw_payload string, lat double, lng double"

    def reader(self, schema) -> PlaceReader:
        return PlaceReader(self.options)
