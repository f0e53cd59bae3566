"""Spike tables, waveform extraction, templates and shape features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.columns import at, first_argmax
from .samples import random_of_each
from .voltage import with_margins

#: Samples before the trough, samples of a waveform.
TROUGH_OFFSET, LENGTH = 42, 128
#: Clusters whose places are summed together.
RANGE = 10_000


def far_from_ends(spikes: DataFrame, ns: int, trough_offset: int = TROUGH_OFFSET, length: int = LENGTH) -> DataFrame:
    """Spikes whose waveform lies within the recording."""
    return spikes.where((F.col("sample") > trough_offset) & (F.col("sample") < ns - (length - trough_offset)))


def waveform_table(spikes: DataFrame, ns: int | None = None, most: int = 256, seed: int = 0, trough_offset: int = TROUGH_OFFSET, length: int = LENGTH) -> DataFrame:
    """At most ``most`` spikes of each cluster, those of the least hashes, with their place in the cluster and in the table.

    ``spikes``: spike, sample, cluster, ...  A negative sample is padding.
    """
    rows = spikes.where("sample >= 0")
    rows = rows if ns is None else far_from_ends(rows, ns, trough_offset, length)
    return with_places(random_of_each(rows, "cluster", "spike", most, seed))


def with_places(rows: DataFrame) -> DataFrame:
    """``index_within_clusters`` by time and ``waveform_index`` by cluster, then time.

    The index over all clusters adds each cluster's start, summed from the
    counts, to the place within it: no sort of all rows in one task.
    """
    within = Window.partitionBy("cluster").orderBy("sample", "spike")
    placed = rows.withColumn("index_within_clusters", (F.row_number().over(within) - 1).cast("long"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    # clusters by ranges: sums within each range, and what the ranges before hold
    dealt = sizes.withColumn("range", F.floor(F.col("cluster") / RANGE))
    ranges = dealt.groupBy("range").agg(F.sum("size").alias("all"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("range").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = dealt.withColumn("inner", inner).join(ranges, "range").select("cluster", (F.col("before") + F.col("inner")).alias("start"))
    return placed.join(before, "cluster").withColumn("waveform_index", F.col("start") + F.col("index_within_clusters")).drop("start")


def cluster_summary(table: DataFrame) -> DataFrame:
    """cluster, count, first_index, last_index."""
    return table.where("sample >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("count"), F.min("waveform_index").alias("first_index"), F.max("waveform_index").alias("last_index"))


def blocks_of(spikes: DataFrame, size: int) -> DataFrame:
    """Spikes with the block of ``size`` samples that they fall into."""
    return spikes.withColumn("block", F.floor(F.col("sample") / size))


def to_blocks(samples: DataFrame, size: int) -> DataFrame:
    """Long rows (channel, sample, v; every sample from 0 on) as arrays of ``size`` samples: channel, block, samples."""
    dealt = samples.groupBy("channel", F.floor(F.col("sample") / size).alias("block"))
    return dealt.agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "v"))), lambda x: x["v"]).alias("samples"))


def extract(spikes: DataFrame, traces: DataFrame, edges: DataFrame, trough_offset: int = TROUGH_OFFSET, length: int = LENGTH, size: int = 30_000, missing: float | None = float("nan")) -> DataFrame:
    """Waveforms of spikes on the neighbours of their peak channel: spike, slot, neighbour, samples.

    ``spikes``: spike, sample, channel; ``traces``: channel, block, samples
    (arrays of ``size`` samples, the last shorter); ``edges``: channel, slot,
    neighbour.  Each block sees the samples of its neighbours that a waveform
    may reach, and meets its spikes in one join, where a waveform is a slice:
    no row is made for a sample.  A sample that is not there is ``missing``.
    """
    wide = with_margins(traces.select("channel", "block", "samples"), trough_offset, length)
    some = lambda n: F.array_repeat(F.lit(missing).cast("double"), n)
    before = F.concat(some(F.lit(trough_offset) - F.size("head")), "head")
    held = wide.select(F.col("channel").alias("neighbour"), "block", F.concat(before, "samples", "tail", some(F.lit(length))).alias("around"))
    wanted = spikes.join(edges, "channel").select("spike", "sample", "slot", "neighbour", F.floor(F.col("sample") / size).alias("block"))
    made = F.slice("around", (F.col("sample") - F.col("block") * size + 1).cast("int"), F.lit(length))
    # the recording may end within the slice, or before it
    full = F.concat(F.coalesce(made, F.array().cast("array<double>")), some(F.lit(length)))
    out = wanted.join(held, ["neighbour", "block"], "left")
    return out.select("spike", "slot", "neighbour", F.slice(full, 1, length).alias("samples"))


def load(waveforms: DataFrame, labels: DataFrame | None = None, indices: DataFrame | None = None) -> DataFrame:
    """Waveforms of the clusters in ``labels`` and the places in ``indices`` (index_within_clusters)."""
    out = waveforms if labels is None else waveforms.join(labels, "cluster", "left_semi")
    return out if indices is None else out.join(indices, "index_within_clusters", "left_semi")


def templates(df: DataFrame, keys: tuple[str, ...] = ("cluster", "trace", "sample")) -> DataFrame:
    """Median over waveforms of each cell, NaN passed over."""
    return df.groupBy(*keys).agg(F.median(F.when(~F.isnan("v"), F.col("v"))).alias("template"), F.count(F.lit(1)).alias("fold"))


def coordinates(spikes: DataFrame, edges: DataFrame, geometry: DataFrame) -> DataFrame:
    """x and y of each spike's neighbour channels; null where a slot has no site."""
    sites = geometry.select(F.col("ind").alias("neighbour"), "x", "y")
    return spikes.join(edges, "channel", "left").join(sites, "neighbour", "left").select("spike", "slot", "neighbour", "x", "y")


def maxima(df: DataFrame) -> DataFrame:
    """Per trace of each waveform: time and value of the greatest absolute value, the first of equals."""
    one = F.array_max(F.transform("samples", lambda x, i: F.struct(F.abs(x).alias("m"), (-i).alias("i"), x.alias("x"))))
    return df.select("waveform_index", "trace", one.alias("best")).select("waveform_index", "trace", (-F.col("best.i")).cast("long").alias("time_idx"), F.col("best.m").alias("max_abs"), F.col("best.x").alias("val"))


def _peak(traces: Column) -> Column:
    """Greatest absolute value, of the first trace and time of equals."""
    cells = F.flatten(F.transform(traces, lambda tr, k: F.transform(tr, lambda x, i: F.struct(F.abs(x).alias("m"), (-k).alias("k"), (-i).alias("i"), x.alias("x")))))
    return F.array_max(cells)


def maximum(df: DataFrame) -> DataFrame:
    """Per waveform: trace, time and value of its peak."""
    best = df.select("waveform_index", _peak(F.col("traces")).alias("b"))
    return best.select("waveform_index", (-F.col("b.k")).cast("long").alias("peak_trace_idx"), (-F.col("b.i")).cast("long").alias("peak_time_idx"), F.col("b.x").alias("peak_val"))


def parabolic_maximum(values: Column) -> Column:
    """Struct (i, v): place and value of the maximum of an array, by a parabola through its neighbours."""
    i = first_argmax(values)
    a, b, c = at(values, i - 1), at(values, i), at(values, i + 1)
    curve, slope = (a - 2 * b + c) / 2, (c - a) / 2
    move = -slope / F.when(curve == 0, 0.5).otherwise(curve) / 2
    edge = (i == 0) | (i == F.size(values) - 1)
    return F.struct(F.when(edge, i.cast("double")).otherwise(i + move).alias("i"), F.when(edge, b).otherwise(b + move * slope + move * move * curve).alias("v"))


def _first_max(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each row the place of its greatest value between two places (the second excluded), the first of equals."""
    i = np.arange(x.shape[1])
    return np.where((i >= low[:, None]) & (i < high[:, None]), x, -np.inf).argmax(1)


def shape_features(x: np.ndarray, fs: float, k: int) -> dict[str, np.ndarray]:
    """Features of tapered waveforms (waveforms, traces, samples), as :func:`features` names them; NaN where there is none."""
    m, _, n = x.shape
    rows, last = np.arange(m), np.full(m, n)
    best = np.abs(x).reshape(m, -1).argmax(1)
    trace, pt = np.divmod(best, n)
    real = x[rows, trace]
    pv, sign = real[rows, pt], -np.sign(real[rows, pt])
    tt = _first_max(real * sign[:, None], pt, last)
    tv = real[rows, tt]
    over = lambda a, b: np.divide(a, b, out=np.full(m, np.nan), where=b != 0)
    swap = (pv > 0) & (np.abs(over(pv, tv)) <= 1.5)
    pt, pv, first = np.where(swap, tt, pt), np.where(swap, tv, pv), tt
    sign = np.where(swap, -np.sign(pv), sign)
    turned = real * sign[:, None]
    arr = np.where(swap[:, None], real, turned)
    tt = np.where(swap, _first_max(turned, pt, last), first)
    tv = real[rows, tt]
    tip = np.where(pt > 0, _first_max(arr, np.zeros(m, int), pt), -1)
    i = np.arange(n)
    above = arr - (pv / 2 * sign)[:, None] > 0
    later, sooner = above & (i >= pt[:, None]), above & (i < pt[:, None])
    post = np.where(later.any(1), later.argmax(1), 0)
    pre = np.where(sooner.any(1), n - 1 - sooner[:, ::-1].argmax(1), n - 1)
    rec = np.minimum(tt + k, n - 1)
    value = lambda at: arr[rows, at] * sign
    ratio, none = np.abs(over(pv, tv)), tip < 0
    tipv, recv = np.where(none, np.nan, value(tip)), value(rec)
    slope = lambda rise, a, b: over(rise, (a - b) / fs)
    with np.errstate(divide="ignore"):
        log = np.where(ratio > 0, np.log(ratio), np.nan)
    return {
        "peak_trace_idx": trace,
        "peak_time_idx": pt,
        "peak_val": pv,
        "invert_sign_peak": sign,
        "trough_time_idx": tt,
        "trough_val": tv,
        "peak_to_trough_ratio": ratio,
        "peak_to_trough_ratio_log": log,
        "tip_time_idx": np.where(none, np.nan, tip),
        "tip_val": tipv,
        "peak_to_trough_duration": (tt - pt) / fs,
        "half_peak_post_time_idx": post,
        "half_peak_pre_time_idx": pre,
        "half_peak_post_val": value(post),
        "half_peak_pre_val": value(pre),
        "half_peak_duration": (post - pre) / fs,
        "recovery_time_idx": rec,
        "recovery_val": recv,
        "depolarisation_slope": slope(pv - tipv, pt, tip),
        "repolarisation_slope": slope(tv - pv, tt, pt),
        "recovery_slope": slope(recv - tv, rec, tt),
    }


def features(df: DataFrame, fs: float = 30_000, length: int = LENGTH, recovery_ms: float = 0.16) -> DataFrame:
    """Shape features of waveforms (waveform_index, traces: arrays of ``length`` samples).

    The peak is the greatest absolute value after tapering; the trough the
    greatest value of the inverted trace from it on, the tip before it.  Where
    a positive peak is at most 1.5 times its trough, the two swap.  Without a
    sample before the peak there is no tip, and features of it are null.
    Waveforms are read in batches, all that have as many traces at once; one
    without traces has no features.
    """
    k = int(round(recovery_ms * fs / 1000))
    if k >= length:
        raise ValueError("the recovery point lies outside of the waveform")
    at = np.arange(length)
    ramp = lambda x, low, high: np.clip((1 - np.cos(np.clip((x - low) / (high - low), 0, 1) * np.pi)) / 2, 0, 1)
    fade = ramp(at, 0, 5) * (1 - ramp(at, length - 5, length))
    names = list(shape_features(np.ones((1, 1, length)), fs, k))
    kind = df.schema["waveform_index"].dataType.simpleString()
    whole = {c for c in names if c.endswith("_idx")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            traces = batch.column(1)
            found = {c: np.full(batch.num_rows, np.nan) for c in names}
            count = pc.fill_null(pc.list_value_length(traces), 0).to_numpy(zero_copy_only=False)
            for n in np.unique(count[count > 0]):
                rows = np.flatnonzero(count == n)
                one = traces.take(pa.array(rows)).flatten()
                if (pc.fill_null(pc.list_value_length(one), 0).to_numpy(zero_copy_only=False) != length).any():
                    raise ValueError(f"a trace has not {length} samples")
                x = np.nan_to_num(one.flatten().to_numpy(zero_copy_only=False).astype(float), posinf=np.inf, neginf=-np.inf)
                for c, v in shape_features(x.reshape(len(rows), int(n), length) * fade, fs, k).items():
                    found[c][rows] = v
            columns = [pa.array(np.nan_to_num(v).astype(np.int64), mask=np.isnan(v)) if c in whole else pa.array(v, mask=np.isnan(v)) for c, v in found.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["waveform_index", *names])

    shape = f"waveform_index {kind}, " + ", ".join(f"{c} {'bigint' if c in whole else 'double'}" for c in names)
    return df.select("waveform_index", F.col("traces").cast("array<array<double>>").alias("traces")).mapInArrow(run, shape)


def spatial_spread(df: DataFrame, geometry: DataFrame) -> DataFrame:
    """Distance from the peak trace, weighted by each trace's signed peak: waveform_index, spread."""
    per = maxima(df.select("waveform_index", F.posexplode("traces").alias("trace", "samples")))
    top = per.groupBy("waveform_index").agg(F.max_by("trace", F.struct("max_abs", -F.col("trace"))).alias("peak"))
    g = geometry.select("ind", "x", "y")
    placed = per.join(top, "waveform_index").join(g.toDF("trace", "x", "y"), "trace").join(g.toDF("peak", "px", "py"), "peak")
    far = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    return placed.groupBy("waveform_index").agg((F.sum(far * F.col("val")) / F.nullif(F.sum("val"), F.lit(0.0))).alias("spread"))


def pre_post(df: DataFrame, peaks: DataFrame) -> DataFrame:
    """Long rows with ``pre`` (value strictly before the peak) and ``post`` (from it on), else null."""
    joined = df.join(peaks.select("waveform_index", "peak_time_idx"), "waveform_index")
    early = F.col("sample") < F.col("peak_time_idx")
    return joined.withColumn("pre", F.when(early, F.col("v"))).withColumn("post", F.when(~early, F.col("v"))).drop("peak_time_idx")


def random_waveforms(spark, n: int, clusters: int = 10, sites: np.ndarray | None = None, fs: float = 30_000, length: int = LENGTH, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """``n`` modelled waveforms: waveform_index, cluster, traces; each cluster has a place beside the sites, each spike some noise.

    A row depends on its own number and the seed alone.
    """
    grid = np.c_[np.tile([43, 11, 59, 27], 10), np.repeat(np.arange(20), 2) * 20.0 + 20] if sites is None else sites
    t = np.arange(length) - TROUGH_OFFSET
    spike = -np.exp(-((t / 5.0) ** 2)) + 0.4 * np.exp(-(((t - 12) / 8.0) ** 2))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            traces = []
            for i in batch["id"]:
                place = np.random.default_rng([seed, int(i % clusters)])
                source = np.array([place.uniform(grid[:, 0].min(), grid[:, 0].max()), place.uniform(grid[:, 1].min(), grid[:, 1].max())])
                w = K.model_waveform(spike, source, grid, fs) * 50**3
                traces.append((w + noise * np.random.default_rng([seed, clusters, int(i)]).normal(size=w.shape)).tolist())
            yield pd.DataFrame({"waveform_index": batch["id"], "cluster": batch["id"] % clusters, "traces": traces})

    return spark.range(n).mapInPandas(made, "waveform_index bigint, cluster bigint, traces array<array<double>>")


def shifted(df: DataFrame, cells: DataFrame, fs: float | None = None) -> DataFrame:
    """Waveforms moved onto their cluster's median template: waveform_index, cluster, lag, traces.

    ``df``: waveform_index, cluster, traces; ``cells``: the same as rows
    (cluster, trace, sample, v).  The lag is that of the template's peak trace,
    by correlation; with ``fs`` by the slope of the phase, whose line is found
    once a cluster.  A constant template moves nothing.  A cluster's template is
    a small array that meets its waveforms in a join, so that a large cluster is
    no larger a task.
    """
    rows = templates(cells).groupBy("cluster", "trace").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "template"))), lambda x: x["template"]).alias("t"))
    peak = rows.groupBy("cluster").agg(F.max_by(F.struct("trace", "t"), F.struct(F.array_max(F.transform("t", F.abs)), -F.col("trace"))).alias("best"))

    def calibrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [K.phase_calibration(np.asarray(t, float), fs) if fs else (0.0, 0.0) for t in batch["t"]]
            yield batch.assign(slope=[x for x, _ in lines], start=[x for _, x in lines])

    peak = peak.select("cluster", F.col("best.trace").cast("int").alias("trace"), "best.t")
    kind = df.schema["cluster"].dataType.simpleString()
    peak = peak.mapInPandas(calibrate, f"cluster {kind}, trace int, t array<double>, slope double, start double")
    joined = df.select("waveform_index", "cluster", "traces").join(peak, "cluster")

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lags, moved = [], []
            for traces, at, t, *line in zip(batch["traces"], batch["trace"], batch["t"], batch["slope"], batch["start"], strict=True):
                cube = np.stack([np.asarray(x, float) for x in traces])
                t = np.asarray(t, float)
                lag = K.shift_by_correlation(t, cube[at])[1] if fs is None else K.shift_by_phase(t, cube[at], fs, tuple(line))[1]
                lags.append(float(lag))
                moved.append([x.tolist() for x in K.shift(cube, lag)])
            yield pd.DataFrame({"waveform_index": batch["waveform_index"], "cluster": batch["cluster"], "lag": lags, "traces": moved})

    return joined.mapInPandas(move, "waveform_index bigint, cluster bigint, lag double, traces array<array<double>>")


def without_nan(df: DataFrame, column: str = "traces") -> DataFrame:
    """Waveforms with NaN and null samples as zero."""
    return df.withColumn(column, F.transform(column, lambda tr: F.transform(tr, lambda x: F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))))


def one_channel(df: DataFrame) -> DataFrame:
    """Each trace of each waveform as a waveform of its own: waveform_index, trace, samples."""
    return df.select("waveform_index", F.posexplode("traces").alias("trace", "samples"))
