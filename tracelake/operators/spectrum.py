"""Spectral densities of whole recordings from their blocks, by mergeable sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .voltage import with_margins


def density(df: DataFrame, fs: float, block: int, size: int = 256) -> DataFrame:
    """One-sided power density of each channel over a recording: channel, bin, f, density.

    ``df``: block, channel, samples (``block`` of them, the last block's may be
    fewer).  Hann segments of ``size`` samples that overlap by half, their means
    removed, over blocks' ends too: a segment belongs to the block that it
    begins in, which sees the first samples of the next one.  A recording
    shorter than a segment is one.  A task gives one sum for each channel it
    has met, and these are summed; no task holds a recording.
    """
    total = df.agg(F.max(F.col("block") * block + F.size("samples"))).first()[0] or 0
    size = min(size, total)
    if size - 1 > block:
        raise ValueError(f"segments of {size} samples are longer than a block of {block} and the one after it can give")
    step = max(1, size - size // 2)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / max(size, 1))
    scale = np.full(size // 2 + 1, 2.0)
    scale[0] = 1
    if size % 2 == 0:
        scale[-1] = 1
    names = ["channel", "n", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for channel, number, own, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, low = np.asarray(x, float), number * block
                starts = np.arange(-(-low // step) * step, min(low + own, low + len(x) - size + 1), step) - low
                if len(starts):
                    parts = x[starts[:, None] + np.arange(size)]
                    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window)) ** 2
                    sums = held.setdefault(channel, [0, np.zeros(size // 2 + 1)])
                    sums[0] += len(starts)
                    sums[1] += power.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.list_(pa.float64()))], names=names)

    if not size:
        return df.sparkSession.createDataFrame([], "channel bigint, bin bigint, f double, density double")
    wide = with_margins(df.select("block", "channel", "samples"), 1, size - 1).select(F.col("channel").cast("long").alias("channel"), "block", F.size("samples").alias("own"), F.concat("samples", "tail").alias("x"))
    sums = wide.mapInArrow(run, "channel bigint, n bigint, sums array<double>").select("channel", "n", F.posexplode("sums").alias("bin", "power"))
    summed = sums.groupBy("channel", "bin").agg((F.sum("power") / F.sum("n")).alias("power"))
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in scale / fs / (window**2).sum())), F.col("bin") + 1) if size <= 2048 else F.lit(2.0 / fs / float((window**2).sum())) * F.when((F.col("bin") == 0) | ((F.col("bin") == size // 2) & F.lit(size % 2 == 0)), 0.5).otherwise(1.0)
    return summed.select("channel", F.col("bin").cast("long").alias("bin"), (F.col("bin") * (fs / size)).alias("f"), (F.col("power") * weight).alias("density"))


def log_density(spectrum: DataFrame, fs: float, bins: int = 127) -> DataFrame:
    """channel, i, f, density: means of :func:`density` between ``bins`` + 1 log-spaced edges up to fs / 2; f is a bin's upper edge."""
    edges = np.logspace(0, np.log2(fs / 2), bins + 1, base=2)
    told = F.explode(F.arrays_zip(F.array(*(F.lit(i) for i in range(bins))).alias("i"), F.array(*(F.lit(float(x)) for x in edges[:-1])).alias("a"), F.array(*(F.lit(float(x)) for x in edges[1:])).alias("b")))
    # an edge takes the last frequency at or below it
    step = spectrum.agg(F.max(F.when(F.col("bin") == 1, F.col("f")))).first()[0] or 1.0
    rows = spectrum.select("channel", "bin", "density", told.alias("e")).select("channel", "bin", "density", F.col("e.i").alias("i"), F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    place = lambda c: F.floor(F.col(c) / step + 1e-9)
    inside = rows.where((F.col("bin") >= place("a")) & (F.col("bin") <= place("b")))
    return inside.groupBy("channel", "i").agg(F.first("b").alias("f"), F.avg("density").alias("density"))
