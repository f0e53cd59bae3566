"""Streams of samples: fronts across batches, filters with state, windows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import kernels as K


def stream_fronts(samples: DataFrame, step: float = 1) -> DataFrame:
    """Fronts of a stream (channel, sample, v); each channel's last value is its state."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("sample")
        before = state.get[0] if state.exists else np.nan
        change = np.diff(np.r_[before, rows["v"].to_numpy()])
        state.update((float(rows["v"].iloc[-1]),))
        found = np.abs(change) >= step
        yield pd.DataFrame({"channel": key[0], "sample": rows["sample"].to_numpy()[found], "polarity": change[found]})

    return samples.groupBy("channel").applyInPandasWithState(run, "channel bigint, sample bigint, polarity double", "last double", "append", GroupStateTimeout.NoTimeout)


def stream_filter(blocks: DataFrame, sos: np.ndarray, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """Causal filter of a stream of array rows (keys: whole numbers, first_sample, samples); the sections' delays are its state.

    The result doesn't depend on how the samples are cut into batches.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("first_sample")
        delays = np.array(state.get[0]).reshape(len(sos), 1, 2) if state.exists else np.zeros((len(sos), 1, 2))
        out = []
        for x in rows["samples"]:
            y, delays = K.sosfilt(sos, np.asarray(x, float)[None], delays)
            out.append(y[0])
        state.update((delays.ravel().tolist(),))
        yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "first_sample": rows["first_sample"].to_numpy(), "samples": out})

    shape = "".join(f"{k} bigint, " for k in keys) + "first_sample bigint, samples array<double>"
    return blocks.groupBy(*keys).applyInPandasWithState(run, shape, "delays array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_windows(events: DataFrame, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Count and RMS of values in sliding windows of event time (ts, channel, v)."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", size, slide), "channel").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


def stream_sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Count and RMS of values in sessions: runs of events (ts, channel, v) of a channel with no more than ``gap`` between them."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.session_window("ts", gap), "channel").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within it hold their state in RocksDB, which state of several variables needs, whatever the session names."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def drain(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, with its state in RocksDB, and returns what it wrote under ``at``."""
    with rocksdb(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint").format("parquet").option("path", f"{at}/out").start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")
