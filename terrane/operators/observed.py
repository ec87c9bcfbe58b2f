"""Counters that fill while jobs run: no second scan of what they count."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .bronze import KEY, new_records

#: What an ingest counts, of each source.
INGEST = ("fetched", "new", "duplicate", "errors")


class Counters:
    """Counts by name and label, gathered by observation of frames, and summed over the actions of a driver.

    A frame that is watched must be run by one action; its counts are there when that action has ended. Streams report through
    `listener`, once a batch.
    """

    def __init__(self) -> None:
        self._open: list[tuple[Observation, dict[str, tuple[str, str]]]] = []
        self._sums: dict[tuple[str, str], int] = defaultdict(int)
        self._streams: dict[str, dict[str, tuple[str, str]]] = {}
        self._lock = threading.Lock()

    @staticmethod
    def _columns(labels: list[str] | None, label: Column | None, counts: dict[str, Column]) -> tuple[list[Column], dict[str, tuple[str, str]]]:
        """One sum for each count and label; labels that are not listed are counted under ''."""
        columns, names = [], {}
        for name, test in counts.items():
            for i, value in enumerate([*(labels or ()), None]):
                hit = test if label is None else test & (F.coalesce(label, F.lit("")) == value if value is not None else ~F.coalesce(label, F.lit("")).isin(*(labels or [])))
                names[f"{name}_{i}"] = (name, value or "")
                columns.append(F.count_if(hit).alias(f"{name}_{i}"))
        return columns, names

    def watch(self, df: DataFrame, label: Column | None = None, labels: list[str] | None = None, **counts: Column) -> DataFrame:
        """df, observed: how many rows meet each condition, by label."""
        columns, names = self._columns(labels, label, counts)
        observation = Observation()
        with self._lock:
            self._open.append((observation, names))
        return df.observe(observation, *columns)

    def watch_stream(self, df: DataFrame, name: str, label: Column | None = None, labels: list[str] | None = None, **counts: Column) -> DataFrame:
        """A streaming df, observed under a name that its session's listener knows."""
        columns, self._streams[name] = self._columns(labels, label, counts)
        return df.observe(name, *columns)

    def listener(self) -> StreamingQueryListener:
        """To be added to `spark.streams`: sums what each batch of the watched streams has counted."""
        counters = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None: ...

            def onQueryProgress(self, event) -> None:
                for name, row in event.progress.observedMetrics.items():
                    if name in counters._streams:
                        counters._add(counters._streams[name], row.asDict())

            def onQueryIdle(self, event) -> None: ...

            def onQueryTerminated(self, event) -> None: ...

        return Listener()

    def _add(self, names: dict[str, tuple[str, str]], found: dict[str, int]) -> None:
        with self._lock:
            for column, key in names.items():
                self._sums[key] += found.get(column) or 0

    def sums(self) -> dict[tuple[str, str], int]:
        """(name, label): count. Waits for the actions of the frames that are watched."""
        with self._lock:
            todo, self._open = self._open, []
        for observation, names in todo:
            self._add(names, observation.get)
        return dict(self._sums)

    def frame(self, spark: SparkSession, label: str = "source") -> DataFrame:
        """name, labels (a map), value: what kpi.metric_lines takes. Counts of 0 of no label are left out."""
        rows = [(name, {label: value} if value else {}, n) for (name, value), n in sorted(self.sums().items()) if value or n]
        return spark.createDataFrame(rows, "name string, labels map<string,string>, value long")


def observed_ingest(incoming: DataFrame, existing: DataFrame, counters: Counters, sources: list[str], source: str = "source_code", keys: tuple[str, ...] = KEY) -> DataFrame:
    """The rows to append (as bronze.new_records), counted on their way: fetched, errors (no id, an id of over 255 characters, or no
    value for a key) and new, by source. Rows in error are not appended."""
    bad = F.col("source_poi_id").isNull() | (F.length("source_poi_id") > 255)
    for key in keys:
        bad = bad | F.col(key).isNull()
    seen = counters.watch(incoming, F.col(source), sources, fetched=F.lit(True), errors=bad)
    return counters.watch(new_records(seen.filter(~bad), existing, keys), F.col(source), sources, new=F.lit(True))


def ingest_counts(spark: SparkSession, counters: Counters, sources: list[str]) -> DataFrame:
    """source, fetched, new, duplicate, errors once the append has ended; '' stands for sources that were not listed."""
    sums = counters.sums()
    rows = [(s, sums.get(("fetched", s), 0), sums.get(("new", s), 0), sums.get(("errors", s), 0)) for s in (*sources, "")]
    return spark.createDataFrame(rows, "source string, fetched long, new long, errors long").withColumn("duplicate", F.col("fetched") - F.col("new") - F.col("errors")).select("source", *INGEST)
