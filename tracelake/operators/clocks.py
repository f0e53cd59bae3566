"""Matching of the events of two clocks, without a task that holds a recording.

``events``: rec, side ('a' or 'b'), time.  The lag comes from histograms of
occupied bins, from coarse to fine; candidates from an equality join on cells
of time; and pairs from rounds in which those that are nearest to each other
leave, which gives what taking the nearest pair again and again would.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import FLOOR, OFF, ROUNDS, best_of

#: Coarse bins of a recording at most, and coarse lags that are looked at more closely where bins had to be joined.
MOST_BINS, CLOSER = 1 << 20, 16
#: Bins of a cell in which neighbours in time are looked for first.
CELL_BINS = 1000


def _written(df: DataFrame, work: str) -> DataFrame:
    path = f"{work}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _products(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of two sides' cells and their counts: lags of x behind y, ascending, and sums of products; by all differences where those are few, else by Fourier transform."""
    n = int(max(x.max(), y.max())) + 1
    if len(x) * len(y) <= 2 * n:
        lags = (x[:, None] - y[None, :]).ravel()
        if (nx == 1).all() and (ny == 1).all():
            return np.unique(lags, return_counts=True)
        lags, at = np.unique(lags, return_inverse=True)
        return lags, np.bincount(at, (nx[:, None] * ny[None, :]).ravel()).astype(np.int64)
    size = 1 << (2 * n).bit_length()
    a, b = np.bincount(x, nx, n), np.bincount(y, ny, n)
    c = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    return np.arange(1 - n, n), np.round(np.r_[c[size - (n - 1) :], c[:n]]).astype(np.int64)


def _coarse(closer: int, wide: bool):
    def best(group: pa.Table) -> pa.Table:
        """The lags of the coarse bins' counts with the largest products, and the products beside them; the first of equals where bins are the finest."""
        one, cells, n = (group.column(c).to_numpy() for c in ("one", "cell", "n"))
        k = group.column("k")[0].as_py()
        lags, made = _products(cells[one], cells[~one], n[one], n[~one])
        told = [(int(i), 0, 0, 0) for i in lags[np.argsort(-made, kind="stable")[:closer]]] if k else [best_of(lags, made, wide)]
        first = group.select(["rec", "low", "k"]).slice(0, 1).take(pa.array([0] * len(told)))
        for name, x in zip(("lag", "n", "before", "after"), zip(*told, strict=True), strict=True):
            first = first.append_column(name, pa.array(x, pa.int64()))
        return first

    return best


def clock_lag(events: DataFrame, tbin: float = 0.1, most: int = MOST_BINS, closer: int = CLOSER, wide: bool = False) -> DataFrame:
    """Per recording the lag, in bins, at which most of the occupied bins of its two clocks meet, the first of equals: rec, lag, n, before, after (n at the lags beside it), low.

    ``wide``: the lag with the most at it and beside it, of equals the one with the most at it.
    All lags are tried, at once where a recording has ``most`` bins or fewer.
    Where it has more they are tried on joined ones first, and of the ``closer`` best ranges each
    lag by itself.  A task sees at most ``most`` counts of a recording; the rest
    is sums by recording and lag.
    """
    low = events.groupBy("rec").agg(F.min("time").alias("low"), F.max("time").alias("high"), F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb")).where("na > 0 AND nb > 0")
    span = F.floor((F.col("high") - F.col("low")) / tbin) + 1
    low = low.select("rec", "low", F.greatest(F.lit(0), F.ceil(F.log2(span / most))).cast("int").alias("k"))
    bins = events.join(low, "rec").select("rec", "low", "k", "side", F.floor((F.col("time") - F.col("low")) / tbin).cast("long").alias("bin")).distinct()
    cell = F.expr("shiftright(bin, k)")
    counts = bins.groupBy("rec", "low", "k", (F.col("side") == "a").alias("one"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    kind = events.schema["rec"].dataType.simpleString()
    told = counts.groupBy("rec").applyInArrow(_coarse(closer, wide), f"rec {kind}, low double, k int, lag bigint, n bigint, before bigint, after bigint")
    fine = told.where("k = 0").select("rec", "lag", "n", "before", "after", "low")
    if not low.agg(F.max("k")).first()[0]:
        return fine
    told, bins = told.where("k > 0").withColumnRenamed("lag", "coarse"), bins.where("k > 0")
    # a lag's pairs are in the coarse lags on both sides of it
    shifts = told.select("rec", F.explode(F.array(F.col("coarse") - 1, "coarse", F.col("coarse") + 1)).alias("shift")).distinct()
    a = bins.where("side = 'a'").join(shifts, "rec").select("rec", "low", F.col("bin").alias("a"), (cell - F.col("shift")).alias("cell"))
    b = bins.where("side = 'b'").select("rec", F.col("bin").alias("b"), cell.alias("cell"))
    lags = a.join(b, ["rec", "cell"]).groupBy("rec", "low", (F.col("a") - F.col("b")).alias("lag")).agg(F.count(F.lit(1)).alias("n"))
    beside = F.inline(F.array(*(F.struct((F.col("lag") + d).alias("lag"), *(F.when(F.lit(d == e), F.col("n")).otherwise(0).alias(c) for e, c in ((0, "n"), (1, "before"), (-1, "after")))) for d in (-1, 0, 1))))
    each = lags.select("rec", "low", beside).groupBy("rec", "low", "lag").agg(*(F.sum(c).alias(c) for c in ("n", "before", "after")))
    order = F.struct(F.col("n") + F.col("before") + F.col("after") if wide else F.lit(0), "n", -F.col("lag"))
    joined = each.groupBy("rec", "low").agg(F.max_by(F.struct("lag", "n", "before", "after"), order).alias("m")).select("rec", "m.*", "low")
    return fine.unionByName(joined)


def _near(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """rec, a, b, gap: events of b nearer than ``width`` to where those of a (rec, a, guess) are expected."""
    cell = lambda c: F.floor(F.col(c) / width)
    wide = a.select("rec", "a", "guess", F.explode(F.array(cell("guess") - 1, cell("guess"), cell("guess") + 1)).alias("cell"))
    both = wide.join(b.select("rec", "b", F.floor(F.col("b.time") / width).alias("cell")), ["rec", "cell"])
    gap = F.abs(F.col("guess") - F.col("b.time"))
    return both.select("rec", "a", "b", gap.alias("gap")).where((F.col("b.time") > F.col("guess") - width) & (F.col("b.time") < F.col("guess") + width))


def _nearest_first(near: DataFrame, work: str, taken: DataFrame | None = None) -> DataFrame | None:
    """Pairs (rec, a, b) of candidates, the nearest ones first, each event once and none of ``taken``; ties to the earlier a, then b.

    In each round all pairs leave that are the best of both their events; the
    others' candidates are what is left of them.
    """
    free = lambda df, gone: df.join(gone.select("rec", "a"), ["rec", "a"], "left_anti").join(gone.select("rec", "b"), ["rec", "b"], "left_anti")
    near = near if taken is None else free(near, taken)
    while True:
        near = _written(near, work)
        if near.isEmpty():
            return taken
        order = F.struct("gap", "a", "b")
        first_a = near.groupBy("rec", "a").agg(F.min(order).alias("m"))
        first_b = near.groupBy("rec", "b").agg(F.min(order).alias("o"))
        found = first_a.join(first_b, (first_a["rec"] == first_b["rec"]) & (F.col("m.b") == F.col("b")) & (F.col("m.a") == F.col("o.a"))).select(first_a["rec"], F.col("m.a").alias("a"), F.col("m.b").alias("b"))
        found = _written(found, work)
        taken = found if taken is None else taken.unionByName(found)
        near = free(near, found)


def _off_line(pairs: DataFrame, tbin: float, work: str) -> DataFrame:
    """rec, a, b: those of the pairs that :func:`events.off_line` finds."""
    x, d = F.col("a.time"), F.col("b.time") - F.col("a.time")

    def fit(held: DataFrame) -> DataFrame:
        told = held.groupBy("rec").agg(F.regr_slope(d, x).alias("slope"), F.avg(x).alias("at"), F.avg(d).alias("mid"), F.count(F.lit(1)).alias("n"), (F.regr_syy(d, x) - F.regr_sxy(d, x) * F.regr_slope(d, x)).alias("rest"))
        return told.where(F.col("n") > 2).where(F.col("rest") >= (FLOOR * tbin) ** 2).select("rec", "slope", "at", "mid")

    gap = F.abs(d - F.col("mid") - F.col("slope") * (x - F.col("at")))
    gone, held = None, pairs
    for _ in range(ROUNDS):
        loose = _written(held.join(fit(held), "rec").select("rec", "a", "b", gap.alias("gap")), work)
        limit = loose.groupBy("rec").agg(F.greatest(OFF * F.percentile_approx("gap", 0.5), F.lit(FLOOR * tbin)).alias("limit"))
        off = _written(loose.join(limit, "rec").where("gap > limit").select("rec", "a", "b"), work)
        gone = off if gone is None else gone.unionByName(off)
        if off.isEmpty():
            break
        held = loose.select("rec", "a", "b").join(off.select("rec").distinct(), "rec", "left_semi").join(off, ["rec", "a"], "left_anti")
    return gone


def _between(free: DataFrame, pairs: DataFrame, width: float) -> DataFrame:
    """rec, a, guess: events of a between two matched ones, on the line through those.

    The last matched event before and the first one after are looked for in
    the event's cell, and where there is none in those of all cells before and
    after: a row for each cell.
    """
    rows = free.select("rec", "a", F.lit(None).cast("double").alias("u")).unionByName(pairs.select("rec", "a", F.col("b.time").alias("u"))).withColumn("cell", F.floor(F.col("a.time") / width))
    point = F.when(F.col("u").isNotNull(), F.struct(F.col("a.time").alias("t"), "u"))
    before = Window.partitionBy("rec", "cell").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rec", "cell").orderBy("a").rowsBetween(1, Window.unboundedFollowing)
    inner = rows.withColumns({"p": F.last(point, ignorenulls=True).over(before), "q": F.first(point, ignorenulls=True).over(after)}).where("u IS NULL")
    cells = rows.groupBy("rec", "cell").agg(F.max(point).alias("last"), F.min(point).alias("first"))
    by = Window.partitionBy("rec").orderBy("cell")
    cells = cells.withColumns({"p2": F.last("last", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), "q2": F.first("first", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))}).select("rec", "cell", "p2", "q2")
    held = inner.join(cells, ["rec", "cell"]).select("rec", "a", F.coalesce("p", "p2").alias("p"), F.coalesce("q", "q2").alias("q")).where("p IS NOT NULL AND q IS NOT NULL")
    slope = F.when(F.col("q.t") > F.col("p.t"), (F.col("q.u") - F.col("p.u")) / (F.col("q.t") - F.col("p.t"))).otherwise(0.0)
    return held.select("rec", "a", (F.col("p.u") + (F.col("a.time") - F.col("p.t")) * slope).alias("guess"))


def clock_pairs(events: DataFrame, work: str, tbin: float = 0.1, linear: bool = False) -> DataFrame:
    """Matches per recording: rec, time_a, time_b, drift_ppm, as :func:`events.match_clocks` finds them; rounds are written under ``work``.

    Events with a single candidate within ``tbin`` of the lag are matched
    first, then those with several; pairs off the line through the others are
    let go; then comes what the line through the rest predicts (between two of
    them, unless ``linear``, the line through these).
    """
    counted = events.groupBy("rec", "side", "time").agg(F.count(F.lit(1)).alias("n"))
    events_ = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.struct(F.col("time").alias("time"), k.alias("k")))
    each = _written(counted.select("rec", "side", F.explode(events_).alias("e")), work)
    a, b = (each.where(F.col("side") == s).select("rec", F.col("e").alias(s)) for s in "ab")
    lag = clock_lag(events, tbin, wide=True)
    delta = (F.col("lag") + (F.col("after") - F.col("before")) / (F.col("before") + F.col("n") + F.col("after"))) * tbin
    lag = _written(lag.select("rec", delta.alias("delta")), work)
    near = _written(_near(a.join(lag, "rec").select("rec", "a", (F.col("a.time") - F.col("delta")).alias("guess")), b, tbin), work)
    several = near.groupBy("rec", "a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rec", "a")
    pairs = _nearest_first(near.join(several, ["rec", "a"], "left_anti"), work)
    pairs = _nearest_first(near.join(several, ["rec", "a"], "left_semi"), work, pairs)
    kind = each.schema["rec"].dataType.simpleString()
    if pairs is None:
        return events.sparkSession.createDataFrame([], f"rec {kind}, time_a double, time_b double, drift_ppm double")
    pairs = pairs.join(_off_line(pairs, tbin, work), ["rec", "a"], "left_anti")
    ta, tb = F.col("a.time"), F.col("b.time")
    fit = pairs.groupBy("rec").agg(F.regr_slope(tb, ta).alias("slope"), F.regr_intercept(tb, ta).alias("start"), F.count(F.lit(1)).alias("n"))
    fit = _written(fit.where("n > 1"), work)
    free_a, free_b = (x.join(pairs.select("rec", c), ["rec", c], "left_anti").join(fit, "rec", "left_semi") for x, c in ((a, "a"), (b, "b")))
    free_a = _written(free_a, work)
    guess = free_a.join(fit, "rec").select("rec", "a", (F.col("a.time") * F.col("slope") + F.col("start")).alias("guess"))
    if not linear:
        some = free_a.select("rec").distinct()
        inner = _between(free_a, pairs.join(some, "rec", "left_semi"), CELL_BINS * tbin).withColumnRenamed("guess", "inner")
        guess = guess.join(inner, ["rec", "a"], "left").select("rec", "a", F.coalesce("inner", "guess").alias("guess"))
    pairs = _nearest_first(_near(guess, free_b, tbin), work, pairs)
    slope = pairs.groupBy("rec").agg(F.coalesce(F.when(F.count(F.lit(1)) > 1, F.regr_slope(tb, ta)), F.lit(1.0)).alias("slope"))
    return pairs.join(slope, "rec").select("rec", ta.alias("time_a"), tb.alias("time_b"), ((F.col("slope") - 1) * 1e6).alias("drift_ppm"))
