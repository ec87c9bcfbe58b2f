"""Figures over counters that only grow: increase and rate by window, quantiles of histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _step(before: Column, now: Column) -> Column:
    """What a counter grew by; a counter that fell has started again at zero. Null without an earlier sample."""
    return F.when(now < before, now).otherwise(now - before)


def increases(samples: DataFrame, series: tuple[str, ...], at: str = "ts", value: str = "value", seconds: int = 300) -> DataFrame:
    """series, window_start, increase and rate (increase a second) of each counter by fixed windows.

    A step counts in the window of its later sample, and nothing is extrapolated to the window's borders. Samples without a
    time or a value are left out; the first sample of a series has no step. Steps are taken inside a window first and then
    between the windows of a series, so a series with many samples is as many groups as it has windows.
    """
    placed = samples.filter(F.col(at).isNotNull() & F.col(value).isNotNull()).select(*series, F.col(at).alias("_at"), F.col(value).cast("double").alias("_value"), F.window(at, f"{seconds} seconds")["start"].alias("window_start"))
    spot = F.struct("_at", "_value")
    inside = Window.partitionBy(*series, "window_start").orderBy("_at", "_value")
    ends = placed.withColumn("_grown", _step(F.lag("_value").over(inside), F.col("_value"))).groupBy(*series, "window_start").agg(F.sum("_grown").alias("_grown"), F.min_by("_value", spot).alias("_first"), F.max_by("_value", spot).alias("_last"))
    across = Window.partitionBy(*series).orderBy("window_start")
    grown = F.coalesce("_grown", F.lit(0.0)) + F.coalesce(_step(F.lag("_last").over(across), F.col("_first")), F.lit(0.0))
    return ends.select(*series, "window_start", grown.alias("increase")).withColumn("rate", F.col("increase") / seconds)


def histogram_quantiles(buckets: DataFrame, group: tuple[str, ...], quantiles: dict[str, float], le: str = "le", count: str = "count") -> DataFrame:
    """group and one column for each named quantile, of cumulative buckets (le: upper bound, the last one infinite).

    Buckets of a group with one bound are added first. Inside a bucket values are taken as spread evenly, the lowest one from
    zero if its bound is above zero. A quantile in the infinite bucket is the bound below it. Null where a group has no
    infinite bucket or no observation.
    """
    summed = buckets.groupBy(*group, F.col(le).cast("double").alias("_le")).agg(F.sum(F.col(count).cast("double")).alias("_n"))
    upward = Window.partitionBy(*group).orderBy("_le")
    all_ = Window.partitionBy(*group)
    steps = summed.withColumn("_n", F.max("_n").over(upward)).select(
        *group,
        "_le",
        "_n",
        F.coalesce(F.lag("_n").over(upward), F.lit(0.0)).alias("_below"),
        F.lag("_le").over(upward).alias("_from"),
        F.max(F.when(F.col("_le") == float("inf"), F.col("_n"))).over(all_).alias("_total"),
    )
    low = F.coalesce("_from", F.when(F.col("_le") > 0, 0.0).otherwise(F.col("_le")))

    def at(q: float) -> Column:
        rank = F.col("_total") * q
        inner = low + (F.col("_le") - low) * F.coalesce((rank - F.col("_below")) / F.nullif(F.col("_n") - F.col("_below"), F.lit(0.0)), F.lit(0.0))
        found = F.when(F.col("_le") == float("inf"), F.col("_from")).otherwise(inner)
        return F.min_by(found, F.when((F.col("_total") > 0) & (F.col("_n") >= rank), F.col("_le")))

    return steps.groupBy(*group).agg(*[at(q).alias(name) for name, q in quantiles.items()])
