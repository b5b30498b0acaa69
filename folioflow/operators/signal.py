"""Windowed reduction of sampled signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rms_windows(df: DataFrame, clip: str, i: str, sample: str, width: int) -> DataFrame:
    """Root mean square of every full window of ``width`` samples: ``clip, w, rms``."""
    groups = df.groupBy(clip, F.floor(F.col(i) / width).alias("w")).agg(F.count("*").alias("__n"), F.sqrt(F.avg(F.col(sample) * F.col(sample))).alias("rms"))
    return groups.where(F.col("__n") == width).select(clip, "w", "rms")


def normalised(df: DataFrame, clip: str, value: str, out: str = "level", share: float = 0.95, floor: float = 0.06, power: float = 0.65) -> DataFrame:
    """Values over the clip's nearest-rank 95th percentile, floored, capped at one and bent by a power.

    The percentile is read off the counts of distinct values, not off a collected clip.
    """
    counts = df.groupBy(clip, value).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(clip).orderBy(value)
    ranked = counts.withColumn("__to", F.sum("__n").over(upto))
    sizes = counts.groupBy(clip).agg(F.sum("__n").alias("__all"))
    at = F.least(F.floor(F.col("__all") * share), F.col("__all") - 1)
    edge = ranked.join(sizes, clip).where(F.col("__to") > at).groupBy(clip).agg(F.min(value).alias("__edge"))
    scaled = F.least(F.lit(1.0), F.col(value) / F.greatest("__edge", F.lit(floor)))
    return df.join(edge, clip).withColumn(out, F.pow(scaled, F.lit(power))).drop("__edge")


def smoothed(df: DataFrame, clip: str, order: str, value: str, out: str = "smooth") -> DataFrame:
    """Three taps of 1/4, 1/2, 1/4, the ends repeating themselves."""
    w = Window.partitionBy(clip).orderBy(order)
    v = F.col(value)
    return df.withColumn(out, F.coalesce(F.lag(v).over(w), v) * 0.25 + v * 0.5 + F.coalesce(F.lead(v).over(w), v) * 0.25)
