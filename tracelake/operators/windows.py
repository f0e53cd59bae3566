"""Overlapping sample windows: bounds, valid parts, overlap-add weights, halos."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count(ns: Column, size: int, overlap: int) -> Column:
    """Windows that cover ``ns`` samples."""
    return F.greatest(F.ceil((ns - size) / (size - overlap)) + 1, F.lit(1)).cast("long")


def windows(lengths: DataFrame, size: int, overlap: int, ns: str = "ns") -> DataFrame:
    """A row per window of each row of ``lengths``: iw, first, last (exclusive), and the valid part.

    The valid part drops half of the overlap at both sides, except at the
    recording's ends (``inner_first``, ``inner_last`` drop it there too).
    """
    step, half = size - overlap, overlap // 2
    n = F.col(ns)
    out = lengths.withColumn("iw", F.explode(F.sequence(F.lit(0).cast("long"), count(n, size, overlap) - 1)))
    out = out.withColumn("first", F.col("iw") * step).withColumn("last", F.least(F.col("iw") * step + size, n))
    inner = out.withColumn("inner_first", F.col("first") + half).withColumn("inner_last", F.col("last") - half)
    return inner.withColumn("valid_first", F.when(F.col("first") == 0, F.lit(0)).otherwise(F.col("inner_first")).cast("long")).withColumn("valid_last", F.when(F.col("last") == n, n).otherwise(F.col("inner_last")))


def centre(first: Column, last: Column, fs: float = 1.0) -> Column:
    """Time of a window's middle."""
    return (first + (last - first - 1) / 2) / fs


def splice_weight(sample: Column, first: Column, last: Column, ns: Column, overlap: int) -> Column:
    """Weight of a sample in a window; the weights of overlapping windows sum to one."""
    fade = lambda k: (1 - F.cos(2 * math.pi * k / (2 * (overlap + 1)))) / 2
    into, out_of = sample - first + 1, last - sample
    up = F.when((first > 0) & (into <= overlap), fade(into)).otherwise(1.0)
    down = F.when((last < ns) & (out_of <= overlap), fade(out_of)).otherwise(1.0)
    return up * down


def window_members(samples: DataFrame, size: int, overlap: int, sample: str = "sample") -> DataFrame:
    """Rows of ``samples`` once for each window of the grid that holds them (``iw``), without a join.

    A last window that begins within the recording's end belongs to the grid
    even if ``windows`` ends before it; filter by ``iw`` where that matters.
    """
    step = size - overlap
    low = F.greatest(F.lit(0), F.ceil((F.col(sample) - size + 1) / step)).cast("long")
    high = F.floor(F.col(sample) / step).cast("long")
    return samples.withColumn("iw", F.explode(F.sequence(low, high)))


def even_batches(lengths: DataFrame, n: int, duration: float, ns: str = "ns") -> DataFrame:
    """Starts of ``n`` batches of ``duration`` spread evenly over each recording: batch, start."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("batch")
    return lengths.select("*", k).withColumn("start", F.col("batch") * (F.col(ns) - duration) / (n - 1))
