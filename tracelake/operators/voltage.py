"""Cleaning of voltage traces.

Rows are block, channel, shank, samples (an array).  Filters along time work
row by row in Arrow batches and never shuffle; filters along channels group a
block (and shank), whose size is the block's and never the recording's.

Blocks stand alone by default.  Where they are parts of one recording, give
the steps a ``margin``: each block then sees so many samples of its
neighbours, and its own part of the result is kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K

Kernel = Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column.to_pylist()]) if len(column) else np.zeros((0, 0))


def along_time(df: DataFrame, kernel: Kernel, column: str = "samples", extra: str | None = None) -> DataFrame:
    """``column`` replaced by the kernel of its rows; ``extra`` names a column of numbers that the kernel gets too.

    Rows of one length in a batch are filtered together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(x, float) for x in batch.column(column).to_pylist()]
            out: list = [None] * len(rows)
            sizes = np.array([len(x) for x in rows])
            more = batch.column(extra).to_numpy(zero_copy_only=False) if extra else None
            for n in np.unique(sizes):
                i = np.flatnonzero(sizes == n)
                made = kernel(np.stack([rows[k] for k in i]), *(() if more is None else (more[i],)))
                for k, x in zip(i, made, strict=True):
                    out[k] = x
            columns = [pa.array(out, pa.list_(pa.float64())) if f.name == column else batch.column(k) for k, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def with_margins(df: DataFrame, before: int, after: int, keys: tuple[str, ...] = ("channel",), column: str = "samples") -> DataFrame:
    """``df`` with ``head`` and ``tail``: the last and first samples of the blocks before and after (empty where there is none).

    Blocks meet by number in an equality join; what moves besides the blocks
    themselves is the margins alone.
    """
    on = [*keys, "block"]
    head = df.select(*keys, (F.col("block") + 1).alias("block"), F.slice(column, F.greatest(F.size(column) - before + 1, F.lit(1)), F.lit(before)).alias("head"))
    tail = df.select(*keys, (F.col("block") - 1).alias("block"), F.slice(column, F.lit(1), F.lit(after)).alias("tail"))
    none = F.array().cast(df.schema[column].dataType)
    return df.join(head, on, "left").join(tail, on, "left").select(*df.columns, F.coalesce("head", none).alias("head"), F.coalesce("tail", none).alias("tail"))


def in_margins(df: DataFrame, step: Callable[[DataFrame], DataFrame], margin: int, q: int = 1, keys: tuple[str, ...] = ("channel",), also: str | None = None, tapered: bool = False) -> DataFrame:
    """``step`` over blocks with ``margin`` samples of their neighbours, less what it makes of those.

    Filters with an odd extension want margins as they are; for circular ones
    they may be ``tapered`` from nothing (the recording's own ends never are).
    ``step`` keeps all columns and may take every ``q``-th sample (blocks and
    margins are multiples of it); ``also`` names a second array that it makes.
    """
    if not margin:
        return step(df)
    wide = with_margins(df, margin, margin, keys)
    fade = lambda k: (1 - F.cos((k + 0.5) / margin * np.pi)) / 2
    head = F.transform("head", lambda x, i: x * fade(i + margin - F.size("head"))) if tapered else F.col("head")
    tail = F.transform("tail", lambda x, i: x * fade(margin - 1 - i)) if tapered else F.col("tail")
    wide = wide.select(*(c for c in df.columns if c != "samples"), F.concat(head, "samples", tail).alias("samples"), F.size("head").alias("__head"), F.size("samples").alias("__own"))
    own = lambda c: F.slice(c, F.floor(F.col("__head") / q).cast("int") + 1, F.ceil(F.col("__own") / q).cast("int"))
    return step(wide).withColumns({c: own(c) for c in ("samples", also) if c}).select(*df.columns)


def _side_by_side(group: pd.DataFrame, column: str = "samples") -> tuple[np.ndarray, list[slice]]:
    """A group's arrays as a matrix, and each one's place in its row: zeros stand where a block beside lacks a channel, so that it has no margin there."""
    rows = [np.asarray(x, float) for x in group[column]]
    if "__head" not in group:
        return np.stack(rows), [slice(None)] * len(rows)
    at = (group["__head"].max() - group["__head"]).tolist()
    spans = [slice(a, a + len(x)) for a, x in zip(at, rows, strict=True)]
    out = np.zeros((len(rows), max(s.stop for s in spans)))
    for i, (s, x) in enumerate(zip(spans, rows, strict=True)):
        out[i, s] = x
    return out, spans


def across_channels(df: DataFrame, kernel: Kernel, keys: tuple[str, ...] = ("block",), column: str = "samples", order: str = "channel") -> DataFrame:
    """``column`` replaced by the kernel of each group's matrix (channels, samples)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        x, spans = _side_by_side(group, column)
        return group.assign(**{column: [r[s] for r, s in zip(kernel(x), spans, strict=True)]})

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def high_pass(df: DataFrame, fs: float, corner: float = 300, order: int = 3, margin: int = 0) -> DataFrame:
    """Zero-phase Butterworth high-pass along time."""
    sos = K.butterworth(order, 2 * corner / fs, "highpass")
    return in_margins(df, lambda x: along_time(x, lambda a: K.sosfiltfilt(sos, a)), margin)


def band_pass(df: DataFrame, fs: float, corners: tuple[float, float] = (0.5, 300), order: int = 3, margin: int = 0) -> DataFrame:
    sos = K.butterworth(order, 2 * np.array(corners) / fs, "bandpass")
    return in_margins(df, lambda x: along_time(x, lambda a: K.sosfiltfilt(sos, a)), margin)


def low_band(df: DataFrame, q: int = 12, corner: float = 0.2, margin: int = 0) -> DataFrame:
    """Every q-th sample of the zero-phase low-passed traces."""
    sos = K.butterworth(3, corner, "lowpass")
    return in_margins(df, lambda x: along_time(x, lambda a: K.sosfiltfilt(sos, a)[..., ::q]), margin, q)


def rephase(df: DataFrame, shift: str = "sample_shift", margin: int = 0) -> DataFrame:
    """Traces delayed by each channel's part of a sample."""
    return in_margins(df, lambda x: along_time(x, K.shift, extra=shift), margin, tapered=True)


def to_long(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "samples"), F.posexplode("samples").alias("sample", "v"))


def to_rows(df: DataFrame, keys: tuple[str, ...] = ("block", "channel", "shank")) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("sample", "v")))
    return df.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias("samples"))


def common_reference(df: DataFrame, keys: tuple[str, ...] = ("block", "shank", "sample"), operator: str = "median") -> DataFrame:
    """Long rows less the median or mean over the channels of each sample."""
    w = Window.partitionBy(*keys)
    return df.withColumn("v", F.col("v") - (F.median("v") if operator == "median" else F.avg("v")).over(w))


def reference_blocks(df: DataFrame, operator: str = "median", keys: tuple[str, ...] = ("block", "shank")) -> DataFrame:
    """As :func:`common_reference`, of array rows: a group's arrays meet in one shuffle, and no row is made for a sample."""
    middle = np.median if operator == "median" else np.mean
    return across_channels(df, lambda x: x - middle(x, 0), keys)


def rms(column: Column) -> Column:
    return F.sqrt(F.avg(column * column))


def stack(df: DataFrame, word: str = "label", operator: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """Traces of one word averaged sample by sample: word, sample, v, fold.

    ``operator`` is a name, or any aggregate of a column (built in or a
    grouped-aggregate pandas UDF).
    """
    made = (operator if callable(operator) else {"mean": F.avg, "median": F.median, "sum": F.sum}[operator])(F.col("v"))
    return df.groupBy(word, "sample").agg(made.alias("v"), F.count(F.lit(1)).alias("fold"))


def donor_weights(geometry: DataFrame, labels: DataFrame, p: float = 1.3, radius: float = 20) -> DataFrame:
    """target, channel, w: of each dead or noisy channel (labels 1 and 2) the good ones around, by an equality join on cells.

    Weights fall with distance and end at 0.005.
    """
    sites = geometry.select("ind", "x", "y").join(labels.select(F.col("channel").alias("ind"), "label"), "ind", "left").withColumn("bad", F.coalesce(F.col("label").isin(1, 2), F.lit(False)))
    # beyond this distance no weight reaches 0.005
    reach = radius * (-np.log(0.005)) ** (1 / p)
    cell = F.floor(F.col("y") / float(reach))
    bad = sites.where("bad").select(F.col("ind").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    good = sites.where("NOT bad").select("ind", "x", "y", cell.alias("cell"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    weights = bad.join(good, "cell").withColumn("w", F.exp(-F.pow(F.sqrt(dx * dx + dy * dy) / radius, p))).where("w >= 0.005")
    return weights.select("target", F.col("ind").alias("channel"), "w")


def interpolate_bad(df: DataFrame, geometry: DataFrame, labels: DataFrame, p: float = 1.3, radius: float = 20) -> DataFrame:
    """Long rows with dead and noisy channels (labels 1 and 2) rebuilt from the good ones around.

    A channel with no donor becomes zero.  The table of weights has a row for
    each pair of sites that are near; only rows of donors meet it.
    """
    weights = donor_weights(geometry, labels, p, radius)
    rebuilt = df.join(weights, "channel").groupBy("block", "target", "sample").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("made"))
    bad = labels.where("label IN (1, 2)").select("channel", F.lit(True).alias("bad"))
    out = df.join(bad, "channel", "left").join(rebuilt.withColumnRenamed("target", "channel"), ["block", "channel", "sample"], "left")
    return out.withColumn("v", F.when(F.col("bad"), F.coalesce("made", F.lit(0.0))).otherwise(F.col("v"))).select(*df.columns)


def interpolate_blocks(df: DataFrame, geometry: DataFrame, labels: DataFrame) -> DataFrame:
    """As :func:`interpolate_bad`, of array rows (block, channel, shank, samples)."""
    return _spatial(df, 0.0, geometry, labels, None, None)


def _placed(df: DataFrame, sites: DataFrame) -> DataFrame:
    """Rows with columns of their site; Spark broadcasts a probe's few sites by their size."""
    return df.join(sites, "channel")


def destripe(df: DataFrame, fs: float, geometry: DataFrame, labels: DataFrame | None = None, k_filter: bool | None | Kernel = True, corner: float = 300, epsilon: float | None = 1e-8, margin: int = 0, tapered: bool = False) -> DataFrame:
    """High-pass, re-phasing, interpolation of bad channels, and a spatial filter per shank.

    ``k_filter``: true for the k-filter, false for the common reference, none
    for neither, or a function of a (channels, samples) matrix.  Channels with
    label 3 lie outside the brain: they keep the temporal steps alone.
    ``margin`` samples of the neighbouring blocks are seen, ``tapered`` if asked.
    """
    if margin:
        return in_margins(df, lambda x: destripe(x, fs, geometry, labels, k_filter, corner, epsilon), margin, tapered=tapered)
    return _spatial(_shifted(high_pass(df, fs, corner), geometry), fs, geometry, labels, k_filter, epsilon)


def _shifted(df: DataFrame, geometry: DataFrame) -> DataFrame:
    sites = geometry.select(F.col("ind").alias("channel"), "sample_shift")
    return rephase(_placed(df, sites).select(*df.columns, "sample_shift")).select(*df.columns)


def _spatial(df: DataFrame, fs: float, geometry: DataFrame, labels: DataFrame | None, k_filter, epsilon: float | None) -> DataFrame:
    """Bad channels rebuilt and the spatial filter: a block's arrays meet in one shuffle, and the steps before run once."""
    kernel = spatial_kernel(fs, k_filter, epsilon)
    if labels is None:
        return df if kernel is None else across_channels(df, kernel, ("block", "shank"))
    columns = df.columns
    sites = geometry.select(F.col("ind").alias("channel"), F.col("x").alias("__x"), F.col("y").alias("__y")).join(labels.select("channel", F.col("label").alias("__label")), "channel", "left")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel")
        x, spans = _side_by_side(group)
        label = group["__label"].fillna(0).to_numpy().astype(int)
        x = clean_block(x, fs, group["shank"].to_numpy(), None, (group["__x"].to_numpy(), group["__y"].to_numpy()), label, None, kernel)
        return group[columns].assign(samples=[r[s] for r, s in zip(x, spans, strict=True)])

    return _placed(df, sites).groupBy("block").applyInPandas(run, df.schema)


def destripe_lfp(df: DataFrame, fs: float, geometry: DataFrame, labels: DataFrame | None = None, corners: tuple[float, float] = (0.5, 300), version: int | str = 1, k_filter: bool | None | Kernel = False, margin: int = 0) -> DataFrame:
    """Band-pass, re-phasing, bad channels and a spatial filter (the common reference by default) of low-frequency bands.

    From version 2 on the delays are too small to count here, and are not undone.
    """
    if margin:
        return in_margins(df, lambda x: destripe_lfp(x, fs, geometry, labels, corners, version, k_filter), margin)
    out = band_pass(df, fs, corners)
    if str(version).split(".")[0] in ("1", "3A", "3B1", "3B2"):
        out = _shifted(out, geometry)
    return _spatial(out, fs, geometry, labels, k_filter, 1e-8)


def similarity(df: DataFrame, keys: tuple[str, ...] = ("block",)) -> DataFrame:
    """Projection of each channel on the median trace of its group: keys, channel, xcor.

    ``df``: keys, channel, sample, v; means are removed.
    """
    reference = Window.partitionBy(*keys, "sample")
    centred = df.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy(*keys, "channel")))
    paired = centred.withColumn("r", F.median("v").over(reference))
    paired = paired.withColumn("r", F.col("r") - F.avg("r").over(Window.partitionBy(*keys, "channel")))
    return paired.groupBy(*keys, "channel").agg((F.sum(F.col("v") * F.col("r")) / F.nullif(F.sum(F.col("r") * F.col("r")), F.lit(0.0))).alias("xcor"))


def sliding_median(x: np.ndarray, n: int, begins: bool = True, ends: bool = True) -> np.ndarray:
    """Median of the ``n`` (odd) values around each, the ends repeated; NaN counts as above all numbers.

    Where it neither ``begins`` nor ``ends`` the recording, there are fewer values around the outermost.

    The window is kept in order: a value comes in and one goes out by
    bisection, so that the width hardly counts.
    """
    if n % 2 == 0:
        raise ValueError("the width of a running median has to be odd")
    half = n // 2
    if not len(x):
        return np.zeros(0)
    wide = np.where(np.isnan(x), np.inf, x)
    wide = np.concatenate([np.repeat(wide[:1], half), wide, np.repeat(wide[-1:], half)]).tolist()
    held = sorted(wide[:n])
    out = [held[half]]
    for gone, new in zip(wide, wide[n:], strict=False):
        if gone != new:
            del held[bisect.bisect_left(held, gone)]
            bisect.insort(held, new)
        out.append(held[half])
    made = np.array(out)
    if not (begins and ends):
        there = np.array(wide[half * (not begins) : len(wide) - half * (not ends)])
        for i in range(len(x)):
            if not begins and i < half or not ends and i >= len(x) - half:
                at = i + half * begins
                made[i] = np.median(there[max(0, at - half) : at + half + 1])
    return np.where(np.isposinf(made), np.nan, made) if np.isnan(x).any() else made


def running_median(df: DataFrame, value: str, n: int = 11, keys: tuple[str, ...] = ("block",), order: str = "channel") -> DataFrame:
    """``trend``: median of ``n`` (odd) rows around each, the ends repeated; a task holds the values of one key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group.assign(trend=sliding_median(group[value].to_numpy(float), n))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy(*keys).applyInPandas(run, f"{shape}, trend double")


def median_filter(df: DataFrame, n: int) -> DataFrame:
    """Running median along time of a recording's blocks (block, channel, samples): blocks see half a width of their neighbours.

    The recording's own ends are repeated; a channel that is there for a part
    of the blocks has fewer values around its own ends.
    """
    first, last = df.agg(F.min("block"), F.max("block")).first()

    def step(x: DataFrame) -> DataFrame:
        late = (F.col("__head") == 0) & (F.col("block") != first)
        early = (F.size("samples") == F.col("__head") + F.col("__own")) & (F.col("block") != last)
        x = x.withColumn("__open", late.cast("int") + 2 * early.cast("int"))
        return along_time(x, lambda a, open_: np.stack([sliding_median(r, n, not k & 1, not k & 2) for r, k in zip(a, open_.tolist(), strict=True)]), extra="__open")

    return in_margins(df, step, n // 2) if n > 1 else df


#: Limits of the similarity of dead and noisy channels, of their density at high frequencies, of the similarity outside.
SIMILARITY, DENSITY, OUTSIDE = (-0.5, 1.0), 0.02, -0.75


def _likeness(x: np.ndarray) -> np.ndarray:
    """Projection of each row on the median row, without means; NaN if that is constant.  As :func:`similarity`."""
    x = x - x.mean(1, keepdims=True)
    ref = np.median(x, 0)
    ref = ref - ref.mean()
    power = (ref * ref).sum()
    return x @ ref / power if power else np.full(len(x), np.nan)


def similarity_blocks(df: DataFrame) -> DataFrame:
    """As :func:`similarity`, of array rows: block, channel, xcor."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel")
        return pd.DataFrame({"block": group["block"].to_numpy(), "channel": group["channel"].to_numpy(), "xcor": _likeness(np.stack(group["samples"].to_numpy()).astype(float))})

    return df.select("block", "channel", "samples").groupBy("block").applyInPandas(run, "block bigint, channel bigint, xcor double")


def channel_features(x: np.ndarray, fs: float, similarity_threshold: tuple[float, float] = SIMILARITY, psd_threshold: float = DENSITY, outside_threshold: float | str = OUTSIDE) -> dict[str, np.ndarray]:
    """Features and labels of the channels of a block's matrix, as :func:`bad_channels` has them."""
    whole = _likeness(x)
    slow = sliding_median(_likeness(K.sosfiltfilt(K.butterworth(3, 2 * (300 if fs > 2600 else 1) / fs, "highpass"), x)), 11)
    f, p = K.welch(x * 1e6, fs)
    out = {"rms_raw": np.sqrt((x * x).mean(1)), "xcor_hf": whole - sliding_median(whole, 11), "xcor_lf": slow - 1, "psd_hf": p[:, f > fs / 2 * 0.8].mean(1)}
    limit = _fall(out["xcor_lf"]) if outside_threshold == "adaptive" else float(outside_threshold)
    outside = np.logical_and.accumulate((out["xcor_lf"] < limit)[::-1])[::-1]
    low, high = similarity_threshold
    noisy, dead = (out["xcor_hf"] > high) | (out["psd_hf"] > psd_threshold), out["xcor_hf"] < low
    return out | {"label": np.where(noisy, 2, np.where(dead, 1, np.where(outside, 3, 0)))}


def bad_channels(df: DataFrame, fs: float, similarity_threshold: tuple[float, float] = SIMILARITY, psd_threshold: float = DENSITY, outside_threshold: float | str = OUTSIDE) -> DataFrame:
    """Per block and channel: rms_raw, xcor_hf, xcor_lf, psd_hf and label (0 good, 1 dead, 2 noisy, 3 outside).

    Dead: like its neighbours too little; noisy: too much like nothing, or
    loud at high frequencies; outside: the run of low similarity that reaches
    the last channel.  The threshold of that may be ``adaptive``: the value
    halfway down the smoothed fall of a block's similarity along its channels.
    A block's arrays meet in one shuffle.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel")
        found = channel_features(np.stack(group["samples"].to_numpy()).astype(float), fs, similarity_threshold, psd_threshold, outside_threshold)
        return pd.DataFrame({"block": group["block"].to_numpy(), "channel": group["channel"].to_numpy(), **found})

    return df.select("block", "channel", "samples").groupBy("block").applyInPandas(run, "block bigint, channel bigint, rms_raw double, xcor_hf double, xcor_lf double, psd_hf double, label bigint")


def _fall(x: np.ndarray, smooth: int = 25, drop: float = -0.02) -> float:
    """Similarity at the median of the channels where its moving average falls by more than ``drop``; below all without such."""
    fall = np.flatnonzero(np.diff(np.convolve(x, np.ones(smooth) / smooth, "same")) < drop) if len(x) > smooth else np.zeros(0, int)
    return float(x[int(np.median(fall))]) if len(fall) else -np.inf


def clean_block(x: np.ndarray, fs: float, shank: np.ndarray, shift: np.ndarray | None = None, xy: tuple[np.ndarray, np.ndarray] | None = None, label: np.ndarray | None = None, sos: np.ndarray | None = None, kernel: Kernel | None = None) -> np.ndarray:
    """A block's matrix (channels, samples) filtered, re-phased, with bad channels rebuilt and ``kernel`` over the channels of each shank inside the brain."""
    x = x if sos is None else K.sosfiltfilt(sos, x)
    x = x if shift is None else K.shift(x, shift)
    label = np.zeros(len(x), int) if label is None else label
    if xy is not None and (bad := np.isin(label, (1, 2))).any():
        x = x.copy()
        x[bad] = K.interpolation_weights(*xy, label) @ x
    if kernel is not None:
        x = x.copy()
        for s in np.unique(shank):
            rows = np.flatnonzero((shank == s) & (label != 3))
            if len(rows):
                x[rows] = kernel(x[rows])
    return x


def spatial_kernel(fs: float, k_filter: bool | None | Kernel = True, epsilon: float | None = 1e-8) -> Kernel | None:
    """The k-filter (true), the common reference (false), none, or what is given."""
    if k_filter is True:
        lagc = int(fs / 10) if fs >= 3000 else None
        return lambda x: K.kfilt(x, lagc, epsilon=epsilon)
    return (lambda x: x - np.median(x, 0)) if k_filter is False else k_filter


def label_mode(labels: DataFrame) -> DataFrame:
    """The commonest label of each channel over blocks, the least of equals."""
    counts = labels.groupBy("channel", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("channel").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"))


def source_density(df: DataFrame, dx: float, n: int = 2, sigma: float = 1 / 3, keys: tuple[str, ...] = ("block", "col", "sample"), order: str = "row") -> DataFrame:
    """n-th difference along depth over dx to the n, times conductivity; the ends copy their neighbour."""
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    made = (before - 2 * F.col("v") + after) if n == 2 else (after - F.col("v"))
    inner = df.withColumn("csd", made / dx**n * sigma)
    if n == 1:  # the first row copies the second, the last the one before
        inner = inner.withColumn("csd", F.when(before.isNull(), F.lead("csd").over(w)).otherwise(F.col("csd")))
    return inner.withColumn("csd", F.coalesce("csd", F.lead("csd").over(w), F.lag("csd").over(w)))


def resample_lfp(df: DataFrame, fs: float, q: int, geometry: DataFrame | None = None, labels: DataFrame | None = None, denoise: Kernel | None = None, margin: int = 0) -> DataFrame:
    """Re-phased, high-passed at 2 Hz, bad channels rebuilt, referenced to the good channels' median, every q-th sample.

    ``denoise`` is a kernel of a block's decimated (channels, samples) matrix,
    such as Cadzow's.  The result has ``reference`` too: what was taken away,
    decimated, so that nothing is lost.
    """
    marked = df.withColumn("reference", F.array().cast("array<double>"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel")
        x = np.stack(group["samples"].to_numpy()).astype(float)
        good = group["__label"].fillna(0).to_numpy() == 0
        middle = np.median(x[good], 0) if good.any() else np.zeros(x.shape[1])
        y = K.decimate(x - middle, q)
        y = y if denoise is None else denoise(y)
        return group.drop(columns="__label").assign(samples=list(y), reference=[K.decimate(middle, q)] * len(y))

    def step(x: DataFrame) -> DataFrame:
        out = high_pass(x if geometry is None else _shifted(x, geometry), fs, 2)
        if labels is not None and geometry is not None:
            out = _spatial(out, fs, geometry, labels, None, None)
        told = out.withColumn("__label", F.lit(0)) if labels is None else out.join(labels.select("channel", F.col("label").alias("__label")), "channel", "left").select(*out.columns, F.col("__label").cast("int"))
        return told.groupBy("block").applyInPandas(run, out.schema)

    return in_margins(marked, step, margin, q, also="reference")


def svd_denoise(df: DataFrame, rank: int | None = None) -> DataFrame:
    """Truncated decomposition of each block and shank; rank a quarter of its channels where none is given."""
    return across_channels(df, lambda x: K.svd_denoise(x, rank or max(1, len(x) // 4)), ("block", "shank"))


def cadzow(df: DataFrame, geometry: DataFrame, fs: float = 250, rank: int = 5, fmax: float | None = 100, **how) -> DataFrame:
    """Rank reduction of each block's spectrum on the probe's grid; ``how`` goes to :func:`kernels.cadzow`."""
    sites = {r.ind: (r.x, r.y) for r in geometry.select("ind", "x", "y").collect()}  # a probe's sites

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel")
        xy = np.array([sites[c] for c in group["channel"]])
        made = K.cadzow(np.stack(group["samples"].to_numpy()).astype(float), xy[:, 0], xy[:, 1], fs, rank, fmax=fmax, **{"size": min(64, 2 * (len(xy) // 2)), "overlap": min(32, len(xy) // 2 // 2 * 2), **how})
        return group.assign(samples=list(made))

    return df.groupBy("block").applyInPandas(run, df.schema)


def split_shanks(df: DataFrame, geometry: DataFrame) -> DataFrame:
    """Rows with their site's shank; sync rows (no site) once for each shank."""
    sites = geometry.select(F.col("ind").alias("channel"), F.col("shank").cast("long").alias("to_shank"))
    probe = df.join(sites, "channel")
    # as many copies of the few sync rows as there are shanks
    sync = df.join(sites.select("channel"), "channel", "left_anti").crossJoin(sites.select("to_shank").distinct())
    return probe.unionByName(sync)


def join_shanks(df: DataFrame) -> DataFrame:
    """Inverse of :func:`split_shanks`: sync rows come from the first shank alone."""
    first = F.row_number().over(Window.partitionBy("block", "channel").orderBy("to_shank"))
    return df.withColumn("__n", first).where("__n = 1").drop("__n", "to_shank")
