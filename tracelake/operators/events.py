"""Fronts, saturation, intervals, sync extraction, overlap of spike sorters, clock matching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bits
from .voltage import with_margins


def _along(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def fronts(df: DataFrame, value: str = "v", step: float = 1, keys: tuple[str, ...] = ("channel",), order: str = "sample") -> DataFrame:
    """Rows where the value changes by ``step`` or more, with the signed change as ``polarity``."""
    change = F.col(value) - F.lag(value).over(_along(list(keys), order))
    return df.withColumn("polarity", change).where(F.abs("polarity") >= step)


def rises(df: DataFrame, value: str = "v", step: float = 1, analog: bool = False, falling: bool = False, keys: tuple[str, ...] = ("channel",), order: str = "sample") -> DataFrame:
    """Rows where the value rises by ``step`` or more (analog: where it first is above ``step``); or falls."""
    x = -F.col(value) if falling else F.col(value)
    limit = -step if falling and analog else step
    x = (x > limit).cast("int") if analog else x
    change = x - F.lag(x).over(_along(list(keys), order))
    return df.withColumn("change", change).where(F.col("change") >= (1 if analog else step)).drop("change")


def saturation(df: DataFrame, max_voltage: float, fs: float, v_per_sec: float = 1e-8, proportion: float = 0.2) -> DataFrame:
    """Per block and sample: whether more than ``proportion`` of channels are near the limit or change too fast.

    ``df``: block, channel, sample, v.  The change to the next sample is
    divided by the rate; the last sample has none.
    """
    later = F.lead("v").over(_along(["block", "channel"], "sample"))
    fast = F.coalesce(F.abs(later - F.col("v")) / fs >= v_per_sec, F.lit(False))
    flagged = df.select("block", "sample", (F.abs("v") > 0.96 * max_voltage).cast("int").alias("high"), fast.cast("int").alias("fast"))
    mean = flagged.groupBy("block", "sample").agg(F.avg("high").alias("high"), F.avg("fast").alias("fast"))
    return mean.select("block", "sample", ((F.col("high") > proportion) | (F.col("fast") > proportion)).alias("saturated"))


def fronts_blocks(df: DataFrame, size: int, step: float = 1) -> DataFrame:
    """As :func:`fronts`, of array rows (block, channel, samples; ``size`` samples a block) of one recording: channel, sample, polarity.

    A block sees the last sample of the one before; no window goes over a
    whole recording, and only fronts become rows.
    """
    wide = with_margins(df.select("block", "channel", "samples"), 1, 1)
    before = lambda i: F.when(i == 0, F.get("head", F.lit(0))).otherwise(F.get("samples", i - 1))
    change = F.transform("samples", lambda x, i: F.struct((F.col("block") * size + i).alias("sample"), (x - before(i)).alias("polarity")))
    return wide.select("channel", F.inline(F.filter(change, lambda r: F.abs(r["polarity"]) >= step)))


def saturation_blocks(df: DataFrame, max_voltage: float, fs: float, v_per_sec: float = 1e-8, proportion: float = 0.2, alone: bool = False) -> DataFrame:
    """As :func:`saturation`, of array rows (block, channel, samples) that are parts of one recording: block, saturated (an array).

    Arrays of a block meet in one shuffle; the change at a block's end is that
    to the next block's first sample, of the channels that it has, unless the
    blocks stand ``alone``.
    """
    rows = df.select("block", "channel", "samples")
    rows = rows.withColumn("tail", F.slice("samples", 1, 0)) if alone else with_margins(rows, 1, 1)
    wide = rows.select("block", "channel", F.concat("samples", "tail").alias("samples"), F.size("samples").alias("n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, n = [np.asarray(x, float) for x in group["samples"]], int(group["n"].iloc[0])
        x, fast = np.stack([r[:n] for r in rows]), np.zeros(n)
        high = (np.abs(x) > 0.96 * max_voltage).mean(0)
        fast[: n - 1] = (np.abs(np.diff(x)) / fs >= v_per_sec).mean(0)
        after = [np.abs(r[n] - r[n - 1]) / fs >= v_per_sec for r in rows if len(r) > n > 0]
        fast[n - 1 :] = np.mean(after) if after else 0
        return pd.DataFrame({"block": [group["block"].iloc[0]], "saturated": [(high > proportion) | (fast > proportion)]})

    return wide.groupBy("block").applyInPandas(run, "block bigint, saturated array<boolean>")


def mute_blocks(sat: DataFrame, n: int = 7, alone: bool = False) -> DataFrame:
    """As :func:`mute`, of the rows of :func:`saturation_blocks`: block, mute (an array); a window reaches into the blocks beside, unless they stand ``alone``."""
    half = n // 2
    weights = [math.sin(math.pi / n * (k + 0.5)) for k in range(n)]
    none = F.slice("saturated", 1, 0)
    wide = sat.withColumns({"head": none, "tail": none}) if alone else with_margins(sat, half, half, (), "saturated")
    wide = wide.select("block", F.size("head").alias("h"), F.size("saturated").alias("n"), F.transform(F.concat("head", "saturated", "tail"), lambda x: x.cast("double")).alias("all"))
    near = lambda i, k: F.coalesce(F.get(F.col("all"), F.col("h") + i + (k - half)), F.lit(0.0)) * weights[k]
    gain = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.greatest(F.lit(0.0), 1 - sum((near(i, k) for k in range(n)), F.lit(0.0))))
    return wide.select("block", gain.alias("mute"))


#: Blocks, or groups of them, whose runs are joined together.
FAN = 256


def joined_runs(runs: DataFrame, span: Column | int, end: int, keys: tuple[str, ...] = (), fan: int = FAN) -> DataFrame:
    """Runs (keys, start, last) that follow each other without a gap as one, where no run goes over a multiple of ``span``.

    An associative scan in a tree: in each round the runs of ``fan`` spans
    beside each other are joined; those that touch neither end of that range
    are done, and at most two go on to the next round.  ``end`` is the last
    place there is.
    """
    done, width = None, span
    w = Window.partitionBy(*keys, "range").orderBy("start")
    while True:
        width = width * fan
        ranged = runs.withColumn("range", F.floor(F.col("start") / width))
        fresh = F.coalesce(F.col("start") > F.lag("last").over(w) + 1, F.lit(True)).cast("int")
        runs = ranged.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy(*keys, "range", "run").agg(F.min("start").alias("start"), F.max("last").alias("last")).select(*keys, "start", "last")
        if width > end:
            return runs if done is None else done.unionByName(runs)
        open_ = (F.pmod("start", F.lit(width)) == 0) | (F.pmod(F.col("last") + 1, F.lit(width)) == 0)
        done = runs.where(~open_) if done is None else done.unionByName(runs.where(~open_))
        runs = runs.where(open_)


def intervals_blocks(sat: DataFrame, size: int, flag: str = "saturated", fan: int = FAN) -> DataFrame:
    """As :func:`intervals`, of arrays of ``size`` samples a block: runs that go over a block's end are one.

    Each block gives its runs; those that touch a block's end are joined in a
    tree over ranges of ``fan`` blocks, so no task sees more than two runs of
    each of ``fan`` blocks or ranges.
    """
    edge = F.filter(F.transform(flag, lambda x, i: F.struct(i.alias("i"), (x & ~F.coalesce(F.get(F.col(flag), i - 1), F.lit(False))).alias("up"), (x & ~F.coalesce(F.get(F.col(flag), i + 1), F.lit(False))).alias("down"))), lambda r: r["up"] | r["down"])
    at = F.col("block") * size
    places = lambda name: F.transform(F.filter(F.col("e"), lambda r: r[name]), lambda r: at + r["i"])
    runs = sat.select("block", edge.alias("e")).select(F.inline(F.arrays_zip(places("up").alias("start"), places("down").alias("last"))))
    end = sat.agg(F.max(at + F.size(flag) - 1)).first()[0] or 0
    inner = (F.pmod("start", F.lit(size)) != 0) & (F.pmod(F.col("last") + 1, F.lit(size)) != 0)
    whole = runs.where(inner).unionByName(joined_runs(runs.where(~inner), size, end, fan=fan))
    return whole.select(F.col("start").alias("start_sample"), F.least(F.col("last") + 1, F.lit(end)).alias("stop_sample"))


def mute(sat: DataFrame, n: int = 7) -> DataFrame:
    """Gain of each sample: 1 less the saturation smeared by a cosine window of ``n`` samples, 0 at least."""
    w = _along(["block"], "sample")
    half = n // 2
    total: Column = F.lit(0.0)
    for k in range(-half, half + 1):
        weight = math.sin(math.pi / n * (k + half + 0.5))
        flag = F.col("saturated").cast("double")
        total = total + F.coalesce((F.lag(flag, -k) if k < 0 else F.lead(flag, k)).over(w) if k else flag, F.lit(0.0)) * weight
    return sat.withColumn("mute", F.greatest(F.lit(0.0), 1 - total))


def intervals(df: DataFrame, flag: str = "saturated", keys: tuple[str, ...] = ("block",), order: str = "sample") -> DataFrame:
    """Runs of true: start_sample (first true) and stop_sample (first false after; an open run ends at the last sample)."""
    w = _along(list(keys), order)
    change = F.col(flag).cast("int") - F.lag(F.col(flag).cast("int"), 1, 0).over(w)
    marked = df.select(*keys, order, F.col(flag).alias("f"), F.sum(F.when(change == 1, 1).otherwise(0)).over(w).alias("run"), F.lead(order).over(w).alias("next"), F.max(order).over(Window.partitionBy(*keys)).alias("end"))
    runs = marked.where("f").groupBy(*keys, "run").agg(F.min(order).alias("start_sample"), F.max(F.coalesce("next", "end")).alias("stop_sample"))
    return runs.drop("run")


def sync_fronts(words: DataFrame, fs: float, word: str = "word", order: str = "sample") -> DataFrame:
    """Fronts of the 16 lines in a digital word: time, channel, polarity."""
    lines = words.select(order, F.posexplode(bits(F.col(word))).alias("channel", "v"))
    found = fronts(lines.withColumn("v", F.col("v").cast("int")), order=order)
    return found.select((F.col(order) / fs).alias("time"), "channel", "polarity")


def analog_lines(df: DataFrame, threshold: float = 1.2, percentile: float = 10, window: str = "window") -> DataFrame:
    """Analog sync as 0 and 1: the value less its window's floor percentile, against the threshold."""
    floor_ = df.groupBy(window, "channel").agg(F.percentile("v", percentile / 100).alias("floor"))
    return df.join(floor_, [window, "channel"]).withColumn("bit", ((F.col("v") - F.col("floor")) >= threshold).cast("int")).drop("floor")


def sync_lines(words: DataFrame, analog: DataFrame, threshold: float = 1.2, percentile: float = 10) -> DataFrame:
    """Digital and analog sync together: sample, channel, bit; analog trace k is channel 16 + k.

    ``words``: sample, word; ``analog``: sample, window, channel, v.
    """
    lines = words.select("sample", F.posexplode(bits(F.col("word"))).alias("channel", "bit")).select("sample", F.col("channel").cast("long").alias("channel"), F.col("bit").cast("int").alias("bit"))
    told = analog_lines(analog, threshold, percentile).select("sample", (F.col("channel") + 16).cast("long").alias("channel"), "bit")
    return lines.unionByName(told)


def write_sync(lines: DataFrame, fs: float, out: str) -> DataFrame:
    """Fronts of sync lines (sample, channel, bit) as a table under ``out``: time, channel, polarity, in files sorted by time."""
    found = fronts(lines, "bit").select((F.col("sample") / fs).alias("time"), F.col("channel").cast("short").alias("channel"), F.col("polarity").cast("byte").alias("polarity"))
    found.repartitionByRange("time").sortWithinPartitions("time", "channel").write.parquet(out)
    return lines.sparkSession.read.parquet(out)


def spike_venn(spikes: DataFrame, sorters: list[str], fs: float = 30000, samples_bin: int | None = None, channels_bin: int = 4) -> DataFrame:
    """How many spikes each combination of sorters shares: mask (first sorter highest), n.

    In a bin of time and channel, as many spikes as the fullest sorter has are
    counted, the k-th for those that have k or more.
    """
    width = samples_bin or int(0.4 * fs / 1000)
    binned = spikes.where(F.col("sorter").isin(sorters)).groupBy(F.floor(F.col("sample") / width).alias("t"), F.floor(F.col("channel") / channels_bin).alias("c"))
    counts = binned.agg(*(F.count_if(F.col("sorter") == s).alias(f"n{i}") for i, s in enumerate(sorters)))
    names = [F.col(f"n{i}") for i in range(len(sorters))]
    level = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(*names) if len(names) > 1 else names[0])).alias("k")
    mask = F.concat(*(F.when(F.col(f"n{i}") >= F.col("k"), "1").otherwise("0") for i in range(len(sorters))))
    return counts.select("*", level).groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def _best_lag(x: np.ndarray, y: np.ndarray, wide: bool = False) -> tuple[int, float, float, float]:
    """Of two ascending lists of occupied bins: the first lag of x behind y at which most of them meet, how many do, and at the lags beside it.

    ``wide``: the lag with the most at it and beside it, of equals the one with the most at it.
    By all differences where those are few, else by Fourier transform.
    """
    low = min(x[0], y[0])
    n = int(max(x[-1], y[-1]) - low) + 1
    if len(x) * len(y) <= 8 * n:
        lags, counts = np.unique((x[:, None] - y[None, :]).ravel(), return_counts=True)
        return best_of(lags, counts, wide)
    a, b = np.zeros(n), np.zeros(n)
    a[x - low], b[y - low] = 1, 1
    size = 1 << (2 * n).bit_length()
    c = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    c = np.round(np.r_[c[size - (n - 1) :], c[:n]])
    return best_of(np.arange(1 - n, n), c, wide)


def best_of(lags: np.ndarray, counts: np.ndarray, wide: bool = False) -> tuple[int, int, int, int]:
    """The best of ascending lags by their counts, as :func:`_best_lag` has it, its count and those beside it."""

    step = np.diff(lags)
    before, after = np.r_[0, np.where(step == 1, counts[:-1], 0)], np.r_[np.where(step == 1, counts[1:], 0), 0]
    score = counts + before + after if wide else counts
    i = int(np.argmax(score * (counts.max() + 1) + counts))
    gaps = np.flatnonzero(step == 2) if wide else []
    if len(gaps) and (both := counts[gaps] + counts[gaps + 1]).max() > score[i]:  # a lag without any between two
        j = gaps[np.argmax(both)]
        return int(lags[j]) + 1, 0, int(counts[j]), int(counts[j + 1])
    return int(lags[i]), int(counts[i]), int(before[i]), int(after[i])


def _near_pairs(a: np.ndarray, b: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of a's and ascending b's values nearer than ``width``."""
    lo, hi = np.searchsorted(b, a - width, "right"), np.searchsorted(b, a + width, "left")
    n = np.maximum(hi - lo, 0)
    ia = np.repeat(np.arange(len(a)), n)
    return ia, np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


#: Pairs off a line by more than so many times the median, and by more than this part of a bin, are let go, in so many rounds at most.
OFF, FLOOR, ROUNDS = 10, 1e-3, 4


def off_line(x: np.ndarray, y: np.ndarray, tbin: float) -> np.ndarray:
    """Which of the pairs lie off the line through the others, whose distances from it tell how near they should be."""
    held = np.ones(len(x), bool)
    for _ in range(ROUNDS):
        d = y - x
        at, mid = x[held].mean(), d[held].mean()
        power = ((x[held] - at) ** 2).sum()
        if held.sum() < 3 or not power:
            break
        gap = np.abs(d - mid - ((x[held] - at) * (d[held] - mid)).sum() / power * (x - at))
        if (gap[held] ** 2).sum() < (FLOOR * tbin) ** 2:
            break
        held &= gap <= max(OFF * np.sort(gap[held])[(held.sum() - 1) // 2], FLOOR * tbin)
    return ~held


def match_clocks(tsa: np.ndarray, tsb: np.ndarray, tbin: float = 0.1, linear: bool = False) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Indices of the events of two ascending clocks that belong together, slope and intercept of b over a.

    The lag comes from the correlation of binned events, three bins wide.
    Events with a single candidate within ``tbin`` are matched first, the nearer
    of two that claim the same one; then those with several.  Pairs off the line
    through the others are let go; last comes what a fit through the rest
    predicts.  In the last two steps the nearest pair of what is free goes
    first.  Only pairs within ``tbin`` are ever looked at.
    """
    low = min(tsa.min(), tsb.min())
    lag, top, before, after = _best_lag(*(np.unique(((t - low) / tbin).astype(int)) for t in (tsa, tsb)), True)
    delta = (lag + (after - before) / (before + top + after)) * tbin
    match, taken = np.full(len(tsa), -1), np.zeros(len(tsb), bool)

    def nearest_first(ia: np.ndarray, ib: np.ndarray, gap: np.ndarray) -> None:
        for k in np.argsort(gap, kind="stable").tolist():
            if match[ia[k]] < 0 and not taken[ib[k]]:
                match[ia[k]], taken[ib[k]] = ib[k], True

    ia, ib = _near_pairs(tsa - delta, tsb, tbin)
    gap = np.abs(tsa[ia] - delta - tsb[ib])
    alone = np.bincount(ia, minlength=len(tsa))[ia] == 1
    nearest_first(ia[alone], ib[alone], gap[alone])
    nearest_first(ia[~alone], ib[~alone], gap[~alone])
    found = np.flatnonzero(match >= 0)
    gone = found[off_line(tsa[found], tsb[match[found]], tbin)]
    taken[match[gone]], match[gone] = False, -1
    found = np.flatnonzero(match >= 0)
    if len(found) > 1:
        slope, start = np.polyfit(tsa[found], tsb[match[found]], 1)
        guess = tsa * slope + start
        if not linear:
            inner = (tsa >= tsa[found[0]]) & (tsa <= tsa[found[-1]])
            guess = np.where(inner, np.interp(tsa, tsa[found], tsb[match[found]]), guess)
        free, left = np.flatnonzero(match < 0), np.flatnonzero(~taken)
        ia, ib = _near_pairs(guess[free], tsb[left], tbin)
        nearest_first(free[ia], left[ib], np.abs(guess[free[ia]] - tsb[left[ib]]))
    ia = np.flatnonzero(match >= 0)
    slope, start = np.polyfit(tsa[ia], tsb[match[ia]], 1) if len(ia) > 1 else (1.0, -delta)
    return ia, match[ia], float(slope), float(start)
