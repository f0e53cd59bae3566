"""Whole jobs: cleaning a recording, quality tables, waveform files."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import kernels as K
from ..functions import sql as L
from ..operators import events as E
from ..operators import geometry as G
from ..operators import voltage as V
from ..operators import waveforms as X
from ..sources import metadata as M
from ..sources import recording as R
from ..streaming import stateful as S

from ..views import folder as _folder
from .signals import SQL as SIGNAL_SQL
from .signals import recursion_sql, recursive
from .spikes import SQL as SPIKE_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: Samples that a block sees of its neighbours.
MARGIN = 1024


def destripe_recording(df: DataFrame, out: str, fs: float, geometry: DataFrame, labels: DataFrame | None = None, max_voltage: float = 0.0012, mute: bool = True, k_filter=True, margin: int = MARGIN, size: int | None = None, append: bool = False, padding: int = 0, whitening: np.ndarray | None = None) -> dict[str, DataFrame]:
    """Cleans a recording (block, channel, shank, samples) into ``out``: traces, RMS and saturation tables.

    Blocks see ``margin`` samples of their neighbours.  Saturation is told on
    the raw samples, and its gain mutes the cleaned ones, over blocks' ends
    too; ``size`` is the samples of a block (the greatest there is, if not
    given).  ``append`` adds to what ``out`` holds, ``padding`` repeats the
    last sample so often, ``whitening`` is a matrix over a block's channels.
    """
    spark, mode = df.sparkSession, "append" if append else "errorifexists"
    size = size or df.agg(F.max(F.size("samples"))).first()[0] or 1
    sat = E.saturation_blocks(df, max_voltage, fs)
    clean = V.destripe(df, fs, geometry, labels, k_filter, margin=margin)
    if mute:
        joined = clean.join(E.mute_blocks(sat), "block")
        clean = joined.withColumn("samples", F.zip_with("samples", "mute", lambda v, m: v * m)).select(*df.columns)
    if whitening is not None:
        clean = V.across_channels(clean, lambda x: whitening @ x)
    if padding:
        last = df.agg(F.max("block").alias("__last"))
        more = F.concat("samples", F.array_repeat(F.element_at("samples", -1), padding))
        clean = clean.crossJoin(last).withColumn("samples", F.when(F.col("block") == F.col("__last"), more).otherwise(F.col("samples"))).select(*df.columns)
    clean.write.mode(mode).parquet(f"{out}/traces")
    traces = spark.read.parquet(f"{out}/traces")
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x)
    rms = traces.join(df.select("block").distinct(), "block", "left_semi") if append else traces
    rms.select("block", "channel", F.sqrt(energy / F.size("samples")).alias("rms")).write.mode(mode).parquet(f"{out}/rms")
    E.intervals_blocks(sat, size).write.mode(mode).parquet(f"{out}/saturation")
    return {k: spark.read.parquet(f"{out}/{k}") for k in ("traces", "rms", "saturation")}


_FEATURES = ("dc_offset", "raw", "butter", "destripe", "striping")


def raw_features(df: DataFrame, fs: float, geometry: DataFrame) -> DataFrame:
    """Quality of each channel and block, in microvolts: offset, RMS raw, filtered, cleaned, and of the stripes; labels and their features.

    The filters run once, on a block's arrays together, and bad channels are left as they are.
    """
    corner = 300 if fs > 2600 else 2
    sos, kernel = K.butterworth(3, 2 * corner / fs, "highpass"), V.spatial_kernel(fs)
    sites = geometry.select(F.col("ind").alias("channel"), F.col("sample_shift").alias("__shift"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel")
        x = np.stack(group["samples"].to_numpy()).astype(float)
        high = K.sosfiltfilt(sos, x)
        clean = V.clean_block(high, fs, group["shank"].to_numpy(), group["__shift"].to_numpy(), kernel=kernel)
        level = lambda a: np.sqrt((a * a).mean(1)) * 1e6
        levels = {"dc_offset": x.mean(1) * 1e6, "raw": level(x), "butter": level(high), "destripe": level(clean), "striping": level(high - clean)}
        return pd.DataFrame({"block": group["block"].to_numpy(), "channel": group["channel"].to_numpy(), **levels, **V.channel_features(x, fs)})

    shape = "block bigint, channel bigint, " + ", ".join(f"{c} double" for c in (*_FEATURES, "rms_raw", "xcor_hf", "xcor_lf", "psd_hf")) + ", label bigint"
    return df.join(sites, "channel").groupBy("block").applyInPandas(run, shape)


#: Filter, its corners, spatial filter and density limit of the bands.
BANDS = {"ap": ("highpass", (300,), True, 0.02), "lf": ("bandpass", (2, 200), False, 1.4)}
_TABLE = ("dc_offset", "raw_rms", "butter_rms", "destripe_rms", "striping_rms", "channel_labels", *(f"{c}_{k}" for k in ("raw", "destripe") for c in ("xcor_hf", "xcor_lf", "psd_hf")))


def band_table(df: DataFrame, fs: float, geometry: DataFrame, band: str = "ap") -> DataFrame:
    """Quality of each snippet (block) and channel in one band, twelve columns ``<band>_..``, levels in microvolts.

    Levels raw, filtered, cleaned (by the channels' own labels) and of the
    stripes between; labels; features of the raw and of the cleaned traces.
    Filters run once, on a block's arrays together.
    """
    kind, corners, k_filter, limit = BANDS[band]
    sos = K.butterworth(3, 2 * np.array(corners if len(corners) > 1 else corners[0]) / fs, kind)
    first = sos if band == "ap" else K.butterworth(3, 2 * np.array((0.5, 300)) / fs, "bandpass")
    kernel = V.spatial_kernel(fs, k_filter)
    sites = geometry.select(F.col("ind").alias("channel"), F.col("sample_shift").alias("__shift"), F.col("x").alias("__x"), F.col("y").alias("__y"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel")
        x = np.stack(group["samples"].to_numpy()).astype(float)
        at = {c: group[c].to_numpy() for c in ("shank", "__shift", "__x", "__y")}
        raw = V.channel_features(x, fs, psd_threshold=limit)
        butter = K.sosfiltfilt(sos, x)
        clean = V.clean_block(x, fs, at["shank"], at["__shift"], (at["__x"], at["__y"]), raw["label"], first, kernel)
        after = V.channel_features(clean, fs, psd_threshold=limit)
        level = lambda a: np.sqrt((a * a).mean(1)) * 1e6
        made = [x.mean(1) * 1e6, raw["rms_raw"] * 1e6, level(butter), after["rms_raw"] * 1e6, level(butter - clean), raw["label"]]
        made += [f[c] for f in (raw, after) for c in ("xcor_hf", "xcor_lf", "psd_hf")]
        return pd.DataFrame({"snippet": group["block"].to_numpy(), "channel": group["channel"].to_numpy(), **{f"{band}_{c}": v for c, v in zip(_TABLE, made, strict=True)}})

    shape = "snippet bigint, channel bigint, " + ", ".join(f"{band}_{c} {'bigint' if c == 'channel_labels' else 'double'}" for c in _TABLE)
    return df.select("block", "channel", "shank", "samples").join(sites, "channel").groupBy("block").applyInPandas(run, shape)


def raw_table(ap: DataFrame, lf: DataFrame, fs_ap: float, fs_lf: float, geometry: DataFrame) -> DataFrame:
    """Both bands' :func:`band_table` by snippet and channel; a snippet or channel that one band lacks has nulls there."""
    return band_table(ap, fs_ap, geometry, "ap").join(band_table(lf, fs_lf, geometry, "lf"), ["snippet", "channel"], "full")


def snippets(df: DataFrame, starts: DataFrame, fs: float, seconds: float) -> DataFrame:
    """Parts of a recording (first_sample, channel, shank, samples) as blocks: of each row of ``starts`` (snippet, start in seconds) so many seconds, or what there is of them.

    Rows meet snippets by the seconds that they touch, an equality join.
    """
    n = int(fs * seconds)
    want = starts.select("snippet", F.floor(F.col("start") * fs).alias("__a")).withColumn("__b", F.col("__a") + n)
    touched = lambda a, b: F.explode(F.sequence(F.floor(a / fs), F.floor((b - 1) / fs))).alias("__second")
    rows = df.where(F.size("samples") > 0).withColumn("__end", F.col("first_sample") + F.size("samples"))
    met = rows.select("*", touched(F.col("first_sample"), F.col("__end"))).join(want.select("*", touched(F.col("__a"), F.col("__b"))), "__second")
    # a row and a snippet that share several seconds meet in the first of these
    begin, end = F.greatest("first_sample", "__a"), F.least("__end", "__b")
    met = met.where((F.col("__second") == F.floor(begin / fs)) & (begin < end))
    part = F.slice("samples", (begin - F.col("first_sample") + 1).cast("int"), (end - begin).cast("int"))
    parts = met.groupBy("snippet", "channel", "shank").agg(F.array_sort(F.collect_list(F.struct(begin.alias("at"), part.alias("part")))).alias("parts"))
    return parts.select(F.col("snippet").alias("block"), "channel", "shank", F.flatten(F.transform("parts", lambda r: r["part"])).alias("samples"))


def raw_features_over_snippets(df: DataFrame, fs: float, geometry: DataFrame) -> DataFrame:
    """Per channel the medians of :func:`raw_features` over the snippets (blocks), and the commonest label."""
    each = raw_features(df, fs, geometry)
    named = (*_FEATURES, "rms_raw", "xcor_hf", "xcor_lf", "psd_hf")
    middle = each.groupBy("channel").agg(*(F.median(c).alias(c) for c in named), F.count(F.lit(1)).alias("snippets"))
    return middle.join(V.label_mode(each.select("channel", "label")), "channel")


def convert_shanks(df: DataFrame, out: str, geometry: DataFrame, meta: DataFrame | None = None, q: int = 12, margin: int = 144 * 12) -> dict[str, DataFrame]:
    """A recording of a probe with several shanks as one of each, with its low band: tables ``ap``, ``lf`` (and ``meta``) by shank.

    ``df``: block, channel, samples (sites and sync rows).  Sync rows go with
    every shank, in the low band as every q-th sample.  ``meta`` rows (path,
    meta) get the shank, the band and the saved channels of each part.
    """
    spark = df.sparkSession
    split = V.split_shanks(df, geometry)
    split.write.partitionBy("to_shank").parquet(f"{out}/ap")
    sites = geometry.select(F.col("ind").alias("channel"))
    low = V.low_band(df.join(sites, "channel", "left_semi"), q, 0.8 / q, margin)
    picked = df.join(sites, "channel", "left_anti").withColumn("samples", F.transform(F.filter("samples", lambda x, i: i % q == 0), lambda x: x.cast("double")))
    V.split_shanks(low.unionByName(picked), geometry).write.partitionBy("to_shank").parquet(f"{out}/lf")
    made = {k: spark.read.parquet(f"{out}/{k}") for k in ("ap", "lf")}
    if meta is not None:
        sizes = made["ap"].select("to_shank", "channel").distinct().groupBy("to_shank").agg(F.count(F.lit(1)).alias("n"))
        n_sync = df.select("channel").distinct().join(sites, "channel", "left_anti").agg(F.count(F.lit(1)).alias("n_sync"))
        M.for_shanks(meta, sizes.crossJoin(n_sync)).write.parquet(f"{out}/meta")
        made["meta"] = spark.read.parquet(f"{out}/meta")
    return made


def check_split(df: DataFrame, split: DataFrame) -> DataFrame:
    """One row: whether the shanks' tables hold every row of ``df`` as it was, and how many rows are missing, differ, or are not from it."""
    joined = V.join_shanks(split).select("block", "channel", F.col("samples").alias("made"), F.lit(True).alias("there"))
    both = df.select("block", "channel", "samples", F.lit(True).alias("here")).join(joined, ["block", "channel"], "full")
    told = both.agg(F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("here").isNull()).alias("extra"), F.count_if(F.col("here") & F.col("there") & (F.col("samples") != F.col("made"))).alias("differing"))
    return told.withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("differing") == 0))


def write_waveforms(spikes: DataFrame, blocks: DataFrame, edges: DataFrame, out: str, **how) -> dict[str, DataFrame]:
    """Traces, median templates and the spike table under ``out``; ``blocks`` as in :func:`waveforms.extract`."""
    spark = spikes.sparkSession
    spikes.write.parquet(f"{out}/table")
    X.extract(spark.read.parquet(f"{out}/table"), blocks, edges, **how).write.parquet(f"{out}/traces")
    traces = spark.read.parquet(f"{out}/traces")
    cells = traces.join(spark.read.parquet(f"{out}/table").select("spike", "cluster"), "spike").select("cluster", F.col("slot").alias("trace"), F.posexplode("samples").alias("sample", "v"))
    X.templates(cells).write.parquet(f"{out}/templates")
    return {k: spark.read.parquet(f"{out}/{k}") for k in ("table", "traces", "templates")}


def load_waveforms(spark: SparkSession, out: str, labels: DataFrame | None = None, indices: DataFrame | None = None) -> DataFrame:
    """Waveforms that :func:`write_waveforms` wrote, of some clusters and places, with their rows of the spike table."""
    table = X.load(spark.read.parquet(f"{out}/table"), labels, indices)
    return spark.read.parquet(f"{out}/traces").join(table, "spike")


def waveform_properties(spark: SparkSession, out: str) -> DataFrame:
    """One row on what :func:`write_waveforms` wrote: clusters, spikes, traces of a waveform, samples, spikes of the largest cluster."""
    sizes = spark.read.parquet(f"{out}/table").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_spikes"), F.max("n").alias("most_spikes"))
    return first.crossJoin(spark.read.parquet(f"{out}/traces").agg((F.max("slot") + 1).alias("n_traces"), F.max(F.size("samples")).alias("n_samples")))


def _probe(spark):
    adc, shift = G.converter(F.col("ind"), "1")
    return G.layout(spark, "1", channels=100).withColumn("sample_shift", shift)


def destripe_job(spark, d):
    rows = views.signal(spark, d).select("block", "channel", "shank", "samples")
    out = destripe_recording(rows, _folder(spark, "destripe"), 30000, _probe(spark), max_voltage=0.6, margin=64)
    return out["rms"].select("block", "channel", F.round("rms", 6).alias("rms"))


def raw_quality(spark, d):
    rows = views.signal(spark, d).select("block", "channel", "shank", "samples")
    out = raw_features(rows, 30000, _probe(spark))
    return out.select("block", "channel", "label", *(F.round(c, 3).alias(c) for c in ("dc_offset", "raw", "butter", "destripe", "striping")))


def stream_fronts(spark, d):
    """Fronts of each user's values by a stream over the events file."""
    at = _folder(spark, "stream")
    views.series(spark, d).repartitionByRange(4, "sample").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("channel bigint, sample bigint, v double").parquet(f"{at}/in")
    return S.drain(S.stream_fronts(stream, 40), at).select("channel", "sample", F.round("polarity", 6).alias("polarity"))


def stream_filter(spark, d):
    at = _folder(spark, "stream")
    views.signal(spark, d).select("block", "channel", F.lit(0).cast("long").alias("first_sample"), "samples").write.parquet(f"{at}/in")
    stream = spark.readStream.schema("block bigint, channel bigint, first_sample bigint, samples array<double>").parquet(f"{at}/in")
    out = S.drain(S.stream_filter(stream, K.butterworth(3, 0.1, "highpass"), ("block", "channel")), at)
    return out.select("block", "channel", F.posexplode("samples").alias("sample", "v")).withColumns({"sample": F.col("sample").cast("long"), "v": F.round("v", 6) + F.lit(0.0)})


def _event_stream(spark, d, at):
    rows = views.table(spark, d, "events").select("ts", F.col("user_id").alias("channel"), F.col("value").alias("v"))
    rows.write.parquet(f"{at}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{at}/in")


def stream_windows(spark, d):
    """Sliding windows of events by a stream, all that its watermark has closed."""
    at = _folder(spark, "stream")
    out = S.drain(S.stream_windows(_event_stream(spark, d, at), "1 day", "12 hours"), at)
    return out.select(F.unix_seconds("window.start").alias("start"), "channel", "n", F.round("rms", 6).alias("rms"))


def stream_sessions(spark, d):
    """Sessions of each user's events by a stream, all that its watermark has closed."""
    at = _folder(spark, "stream")
    out = S.drain(S.stream_sessions(_event_stream(spark, d, at), "2 hours"), at)
    return out.select(F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "channel", "n", F.round("rms", 6).alias("rms"))


def saturation_over_blocks(spark, d):
    """Saturated runs of the blocks as one recording: runs over a block's end are one."""
    rows = views.signal(spark, d).select("block", "channel", "samples")
    return E.intervals_blocks(E.saturation_blocks(rows, 0.3, 2, 0.16, 0.06), 64)


def mute_blocks(spark, d):
    rows = views.signal(spark, d).select("block", "channel", "samples")
    out = E.mute_blocks(E.saturation_blocks(rows, 0.3, 2, 0.16, 0.06)).select("block", F.posexplode("mute").alias("sample", "mute"))
    return out.select("block", F.col("sample").cast("long").alias("sample"), (F.round("mute", 6) + F.lit(0.0)).alias("mute"))


def snippet_quality(spark, d):
    rows = views.signal(spark, d).select("block", "channel", "shank", "samples")
    out = raw_features_over_snippets(rows, 30000, _probe(spark))
    return out.select("channel", "label", "snippets", *(F.round(c, 3).alias(c) for c in _FEATURES))


def _shank_geometry(spark):
    return spark.range(99).select(F.col("id").alias("ind"), F.floor(F.col("id") / 25).alias("shank"))


def shank_conversion(spark, d):
    """Shanks' tables of the signal (its last channel as sync), joined again and compared."""
    rows = views.signal(spark, d).select("block", "channel", "samples")
    made = convert_shanks(rows, _folder(spark, "shanks"), _shank_geometry(spark), q=4, margin=16)
    return check_split(rows, made["ap"])


def shank_low_band(spark, d):
    """How many rows and samples of the low band each shank has."""
    rows = views.signal(spark, d).select("block", "channel", "samples")
    made = convert_shanks(rows, _folder(spark, "shanks"), _shank_geometry(spark), q=4, margin=16)
    return made["lf"].groupBy(F.col("to_shank").cast("long").alias("shank")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("samples")).alias("samples"))


def waveform_job(spark, d):
    """Waveforms of a spike table written and read again: each cluster's spikes and their sum of samples."""
    s = views.series(spark, d)
    spikes = s.select((F.col("channel") * 1000000 + F.col("sample")).alias("spike"), "channel", "sample", F.pmod("channel", F.lit(7)).alias("cluster"))
    table = X.with_places(spikes)
    edges = s.select("channel").distinct().select("channel", F.lit(0).cast("long").alias("slot"), F.col("channel").alias("neighbour"))
    at = _folder(spark, "waveforms")
    write_waveforms(table, X.to_blocks(s, 100), edges, at, trough_offset=4, length=8, size=100, missing=0.0)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return load_waveforms(spark, at).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 3).alias("total"))


def recording_scan(spark, d):
    """Part of a recording file through its data source: volts of some channels and samples, by the metadata beside it."""
    at = _folder(spark, "recording").removeprefix("file://").removeprefix("file:")
    os.makedirs(at)
    R.mock_recording(f"{at}/m.ap.bin", 9, 400, 0.6 / 512 / 500)
    gains = "".join(f"({i} 0 0 500 250 1)" for i in range(8))
    with open(f"{at}/m.ap.meta", "w") as f:
        f.write(f"typeThis=imec\nimDatPrb_type=0\nimAiRangeMax=0.6\nnSavedChans=9\nsnsApLfSy=8,0,1\n~imroTbl=(0,8){gains}\n")
    rows = R.read_recording(spark, f"{at}/m.ap.bin", block=100, first=50, last=380, only="0:3,8")
    cells = R.between(rows, 50, 350).select("channel", "first_sample", F.posexplode("samples").alias("i", "v"))
    return cells.select("channel", (F.col("first_sample") + F.col("i")).alias("sample"), F.round(F.when(F.col("channel") == 8, F.col("v")).otherwise(F.col("v") * 1e6), 6).alias("v"))


def sql_delay(spark, d):
    """A delay called from an SQL text."""
    L.register(spark)
    views.signal(spark, d).createOrReplaceTempView("tracelake_signal")
    out = spark.sql("SELECT block, channel, posexplode(signal_delay(samples, 0.3D)) AS (sample, v) FROM tracelake_signal")
    return out.withColumns({"sample": F.col("sample").cast("long"), "v": F.round("v", 6) + F.lit(0.0)})


def sql_windows(spark, d):
    """Windows of each user's events by a table function, and the RMS of a group by another."""
    L.register(spark)
    views.table(spark, d, "events").groupBy(F.col("user_id").alias("rec")).agg(F.count(F.lit(1)).alias("ns")).createOrReplaceTempView("tracelake_lengths")
    return spark.sql("SELECT rec, w.* FROM tracelake_lengths, LATERAL signal_windows(ns, 20, 8) w")


def sql_rms(spark, d):
    L.register(spark)
    views.signal_long(spark, d).createOrReplaceTempView("tracelake_long")
    return spark.sql("SELECT block, channel, round(signal_rms(v), 6) AS rms FROM tracelake_long GROUP BY block, channel")


QUERIES |= {f.__name__: f for f in (recording_scan, sql_delay, sql_windows, sql_rms, destripe_job, raw_quality, snippet_quality, stream_fronts, stream_filter, stream_windows, stream_sessions, mute_blocks, saturation_over_blocks, shank_conversion, shank_low_band, waveform_job)}
SQL["recording_scan"] = """SELECT c AS channel, t AS sample, round(CASE WHEN c = 8 THEN (1 << (t % 15)::INT)::DOUBLE WHEN t < 16 THEN 0 ELSE round((c + 1) / 2.34375::DOUBLE) * 2.34375 END, 6)::DOUBLE AS v
FROM range(50, 350) a(t), (SELECT unnest([0, 1, 2, 3, 8])::BIGINT AS c)"""
SQL["sql_delay"] = SIGNAL_SQL["fshift"]
SQL["sql_windows"] = SPIKE_SQL["windows_firstlast"]
SQL["sql_rms"] = f"WITH {views.SIGNAL} SELECT block, channel, round(sqrt(avg(v * v)), 6) AS rms FROM sig GROUP BY 1, 2"
SQL["stream_fronts"] = f"WITH {views.SERIES}, c AS (SELECT *, v - lag(v) OVER (PARTITION BY channel ORDER BY sample) AS p FROM series) SELECT channel, sample, round(p, 6) AS polarity FROM c WHERE abs(p) >= 40"
SQL["stream_filter"] = recursive(f"""{views.SIGNAL}, src AS MATERIALIZED (SELECT block, channel, sample AS t, v FROM sig), {recursion_sql("out", "src", K.butterworth(3, 0.1, "highpass"))}
SELECT block, channel, t::BIGINT AS sample, round(y, 6) + 0.0 AS v FROM out WHERE t >= 0""")
SQL["stream_windows"] = """WITH w AS (SELECT user_id AS channel, value AS v, (epoch_us(ts) // 43200000000 - k) * 43200 AS start FROM events, range(2) r(k)),
m AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS mark FROM events)
SELECT start::BIGINT AS start, channel, count(*) AS n, round(sqrt(avg(v * v)), 6) AS rms FROM w, m WHERE (start + 86400) * 1000 <= mark GROUP BY 1, 2"""
SQL["stream_sessions"] = """WITH e AS (SELECT user_id AS channel, value AS v, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
r AS (SELECT *, sum((coalesce(gap, 1e15) > 7200000000)::INT) OVER (PARTITION BY channel ORDER BY t) AS run FROM e),
s AS (SELECT channel, min(t) AS start, max(t) + 7200000000 AS "end", count(*) AS n, round(sqrt(avg(v * v)), 6) AS rms FROM r GROUP BY channel, run),
m AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS mark FROM events)
SELECT start, "end", channel, n, rms FROM s, m WHERE "end" <= mark * 1000"""
_SATURATED = """s AS (SELECT block * 64 + sample AS t, channel, v, lead(v) OVER (PARTITION BY channel ORDER BY block, sample) AS nx FROM sig),
f AS (SELECT t, avg((abs(v) > 0.96 * 0.3)::INT) > 0.06 OR coalesce(avg(CASE WHEN nx IS NOT NULL THEN (abs(nx - v) / 2 >= 0.16)::INT END), 0) > 0.06 AS saturated FROM s GROUP BY 1)"""
SQL["saturation_over_blocks"] = f"""WITH {views.SIGNAL}, {_SATURATED}, e AS (SELECT max(t) AS e FROM f), g AS (SELECT t, t - row_number() OVER (ORDER BY t) AS run FROM f WHERE saturated)
SELECT min(t) AS start_sample, least(max(t) + 1, any_value(e)) AS stop_sample FROM g, e GROUP BY run"""
SQL["mute_blocks"] = f"""WITH {views.SIGNAL}, {_SATURATED}, m AS (SELECT a.t, sum(b.saturated::INT * sin(pi() / 7 * (b.t - a.t + 3.5))) AS m FROM f a JOIN range(-3, 4) r(k) ON true JOIN f b ON b.t = a.t + r.k GROUP BY 1)
SELECT t // 64 AS block, t % 64 AS sample, round(greatest(0, 1 - m), 6) + 0.0 AS mute FROM m"""
SQL["shank_conversion"] = "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS differing, true AS same"
SQL["shank_low_band"] = "SELECT s AS shank, count(*) FILTER (vec_id % 100 = 99 OR (vec_id % 100) // 25 = s) AS n, 16 * count(*) FILTER (vec_id % 100 = 99 OR (vec_id % 100) // 25 = s) AS samples FROM embeddings, range(4) t(s) GROUP BY 1"
SQL["waveform_job"] = f"""WITH {views.SERIES}, w AS (SELECT a.channel, a.sample, sum(coalesce(b.v, 0)) AS total FROM series a, range(8) r(i) LEFT JOIN series b ON b.channel = a.channel AND b.sample = a.sample - 4 + i GROUP BY 1, 2)
SELECT channel % 7 AS cluster, count(*) AS n, round(sum(total), 3) AS total FROM w GROUP BY 1"""
