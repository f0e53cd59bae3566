"""Queries that write files and streams of the driver's tables and read them again, and of steps over blocks' ends; their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import views
from ..functions import sql as L
from ..operators import events as E
from ..operators import samples as N
from ..operators import spectrum as P
from ..operators import voltage as V
from ..sources import files as FL
from ..sources import recording as R
from ..streaming import overlap as O
from ..streaming import sink as T
from ..streaming import stateful as S
from . import jobs
from .jobs import _folder, _probe
from .signals import _LABELS, recursive
from .signals import SQL as SIGNAL_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}

_WHOLE = f"{views.SIGNAL}, whole AS (SELECT channel, block * 64 + sample AS t, greatest(-32768, least(32767, round_even(v / 0.001::DOUBLE, 0)))::BIGINT AS v FROM sig)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _recording(spark, d):
    """The blocks of the signal as one recording."""
    return views.signal(spark, d).select((F.col("block") * 64).alias("first_sample"), "channel", "samples")


def _flat(spark, d) -> str:
    at = f"{_folder(spark, 'flat')}/a.bin"
    FL.write_flat(_recording(spark, d), at, 100, scale=0.001, absent=0.0)
    return at


def held(rows, signal):
    """Rows (first_sample, channel, samples) of a recording's file, cut at the ends of the signal's blocks of 64, less what stands for channels that a block lacks."""
    there = signal.select(F.col("block").alias("chunk"), "channel")
    return FL.in_chunks(rows, 64).join(there, ["chunk", "channel"], "left_semi")


def _read(spark, at, block: int):
    spark.dataSource.register(R.RecordingSource)
    return spark.read.format("recording").option("channels", 100).option("block", block).load(at)


@query(f"WITH {_WHOLE} SELECT channel, t AS sample, v FROM whole WHERE channel IN (3, 40, 99) AND t >= 64")
def flat_file(spark, d):
    """The signal as a flat int16 file of many tasks; of three channels, what is read from sample 64 on by filters that reach the file."""
    rows = R.pushed(spark, _flat(spark, d), "channel IN (3, 40, 99) AND first_sample >= 64", channels=100, block=32)
    cells = held(rows, views.signal(spark, d)).select("channel", "first_sample", F.posexplode("samples").alias("i", "v"))
    return cells.select("channel", (F.col("first_sample") + F.col("i")).alias("sample"), F.col("v").cast("long").alias("v"))


@query(f"WITH {_WHOLE} SELECT t // 50 * 50 AS first_sample, channel, count(*) AS n, sum(v)::BIGINT AS total FROM whole GROUP BY 1, 2")
def chunk_file(spark, d):
    """The signal as a chunk-compressed file, 50 samples a chunk, and what its chunks hold."""
    at = _folder(spark, "chunks")
    FL.write_chunks(_recording(spark, d), f"{at}/a.cbin", 100, 50.0, f"{at}-work", scale=0.001, absent=0.0)
    spark.dataSource.register(R.RecordingSource)
    rows = held(spark.read.format("recording").load(f"{at}/a.cbin"), views.signal(spark, d))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    first = F.floor(F.col("first_sample") / 50) * 50
    return rows.groupBy(first.alias("first_sample"), "channel").agg(F.sum(F.size("samples")).alias("n"), F.sum(total).cast("long").alias("total"))


@query(
    f"""WITH {_WHOLE}, b AS (SELECT t // 64 AS chunk, string_agg(printf('%02x%02x', (v & 255)::INT, ((v >> 8) & 255)::INT), '' ORDER BY t, channel) AS x FROM whole GROUP BY 1)
SELECT chunk, sha256(unhex('00' || x)) AS digest FROM b"""
)
def file_chunk_hashes(spark, d):
    """The leaves of a flat file's tree of hashes, a block each; blocks are written with the channels that they have."""
    at = f"{_folder(spark, 'flat')}/a.bin"
    places = FL.write_blocks(_recording(spark, d), at, scale=0.001)
    ranges = places.select(F.floor(F.col("first_sample") / 64).alias("chunk"), "at", "size")
    return FL.chunk_hashes(spark, at, ranges=ranges).select("chunk", F.lower(F.hex("digest")).alias("digest"))


@query(f"WITH {_WHOLE} SELECT channel, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (t % 7))::BIGINT AS weighted FROM whole GROUP BY 1")
def stream_recording(spark, d):
    """A flat file followed as a stream and appended to another one, block by block."""
    at = _flat(spark, d)
    spark.dataSource.register(R.RecordingSource)
    stream = spark.readStream.format("recording").option("channels", 100).option("block", 48).load(at)
    T.append_flat(stream, f"{at}.copy.bin", 100, f"{at}-stream").trigger(availableNow=True).start().awaitTermination()
    cells = held(_read(spark, f"{at}.copy.bin", 40), views.signal(spark, d)).select("channel", "first_sample", F.posexplode("samples").alias("i", "v"))
    v = F.col("v").cast("long")
    return cells.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * ((F.col("first_sample") + F.col("i")) % 7)).alias("weighted"))


@query(
    f"""WITH {views.SIGNAL}, w AS (SELECT channel, block * 64 + sample AS t, v FROM sig), n AS (SELECT max(t) + 1 AS n FROM w)
SELECT a.channel, a.t AS first_sample, round(sum(b.v), 6) AS total, count(*) AS n FROM w a JOIN w b ON b.channel = a.channel AND b.t BETWEEN a.t AND a.t + 95 CROSS JOIN n WHERE a.t % 64 = 0 AND a.t + 32 < n.n GROUP BY 1, 2"""
)
def stream_overlaps(spark, d):
    """Windows of 96 samples that overlap by 32, of a stream of blocks of 64 with its end marked."""
    at = _folder(spark, "overlap")
    rows = _recording(spark, d).select("channel", "first_sample", "samples")
    ends = rows.groupBy("channel").agg(F.max(F.col("first_sample") + F.size("samples")).alias("first_sample")).withColumn("samples", F.lit(None).cast("array<double>"))
    rows.unionByName(ends).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("channel bigint, first_sample bigint, samples array<double>").parquet(f"{at}/in")
    out = S.drain(O.stream_overlapping(stream, lambda x: np.array([x.sum(), len(x)]), 64, 0, 32, whole=True), at)
    return out.select("channel", "first_sample", F.round(F.get("samples", F.lit(0)), 6).alias("total"), F.get("samples", F.lit(1)).cast("long").alias("n"))


_WORDS = "w AS (SELECT event_id AS sample, (floor(value * 100)::BIGINT % 65536 + 65536) % 65536 AS word, value AS v, event_id // 1000 AS win FROM events)"


def _words(spark, d):
    e = views.table(spark, d, "events")
    return e.select(F.col("event_id").alias("sample"), F.pmod(F.floor(F.col("value") * 100).cast("long"), F.lit(65536)).alias("word"), F.floor(F.col("event_id") / 1000).alias("window"), F.col("value").alias("v"))


@query(
    f"""WITH {_WORDS}, f AS (SELECT win, quantile_cont(v, 0.1) AS f FROM w GROUP BY 1),
b AS (SELECT k AS channel, (word >> k) & 1 AS bit FROM w, range(16) t(k) UNION ALL SELECT 16, (v - f >= 20)::INT FROM w JOIN f USING (win))
SELECT channel, count(*) AS n, sum(bit)::BIGINT AS high FROM b GROUP BY 1"""
)
def sync_both(spark, d):
    """Digital lines and an analog one together: how often each is high."""
    rows = _words(spark, d)
    lines = E.sync_lines(rows.select("sample", "word"), rows.select("sample", "window", F.lit(0).cast("long").alias("channel"), "v"), threshold=20)
    return lines.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("bit").alias("high"))


@query(
    f"""WITH {_WORDS}, b AS (SELECT sample, k AS channel, ((word >> k) & 1)::BIGINT AS bit FROM w, range(16) t(k)),
c AS (SELECT sample, channel, bit - lag(bit) OVER (PARTITION BY channel ORDER BY sample) AS p FROM b)
SELECT round(sample / 100.0::DOUBLE, 6) AS time, channel, p AS polarity FROM c WHERE p <> 0"""
)
def sync_vectors(spark, d):
    """Fronts of the digital lines as a table in files sorted by time."""
    rows = _words(spark, d).select("sample", "word")
    lines = E.sync_lines(rows, rows.select("sample", F.lit(0).cast("long").alias("window"), F.lit(0).cast("long").alias("channel"), F.lit(0.0).alias("v")).limit(0))
    out = E.write_sync(lines, 100.0, _folder(spark, "sync"))
    return out.select(F.round("time", 6).alias("time"), F.col("channel").cast("long").alias("channel"), F.col("polarity").cast("long").alias("polarity"))


@query("SELECT vec_id AS waveform_index, label::BIGINT AS cluster FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':5'), vec_id) <= 3")
def random_subset(spark, d):
    """Three waveforms of each label, chosen by a hash."""
    return N.random_of_each(views.waveforms(spark, d).select("waveform_index", "cluster"), "cluster", "waveform_index", 3, 5)


@query(
    f"""WITH {views.SIGNAL}, w AS (SELECT channel, block * 64 + sample AS t, v FROM sig), n AS (SELECT max(t) + 1 AS n FROM w),
s AS (SELECT channel, unnest([t // 32, t // 32 - 1]) AS k, t, v FROM w),
g AS (SELECT channel, k, t - k * 32 AS i, v - avg(v) OVER (PARTITION BY channel, k) AS c FROM s, n WHERE k >= 0 AND k * 32 + 64 <= n.n),
f AS (SELECT channel, k, b AS bin, sum(c * (1 - cos(2 * pi() * i / 64)) / 2 * cos(2 * pi() * b * i / 64)) ** 2 + sum(c * (1 - cos(2 * pi() * i / 64)) / 2 * sin(2 * pi() * b * i / 64)) ** 2 AS p FROM g, range(33) r(b) GROUP BY 1, 2, 3)
SELECT channel, bin, bin::DOUBLE AS f, round(avg(p) * CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END / 64 / 24, 6) AS density FROM f GROUP BY 1, 2"""
)
def density_over_blocks(spark, d):
    """Power density of each channel over the blocks as one recording."""
    rows = views.signal(spark, d).select("block", "channel", "samples")
    return P.density(rows, 64, 64, 64).withColumn("density", F.round("density", 6))


@query(
    f"""WITH {views.SIGNAL}, w AS (SELECT channel, block * 64 + sample AS t, v FROM sig), n AS (SELECT max(t) AS n FROM w),
e AS (SELECT channel, t, v FROM w UNION ALL SELECT channel, -1 - k, v FROM w, range(20) r(k) WHERE t = 0 UNION ALL SELECT channel, t + 1 + k, v FROM w, n, range(20) r(k) WHERE t = n.n),
m AS (SELECT channel, t, median(v) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS m FROM e)
SELECT t // 64 AS block, channel, t % 64 AS sample, round(m, 6) + 0.0 AS v FROM m, n WHERE t BETWEEN 0 AND n.n"""
)
def median_over_blocks(spark, d):
    """Running median of 41 samples over the blocks as one recording."""
    out = V.to_long(V.median_filter(views.signal(spark, d).select("block", "channel", "samples"), 41))
    return out.select("block", "channel", F.col("sample").cast("long").alias("sample"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query(SIGNAL_SQL["destripe_car"])
def sql_destripe(spark, d):
    """Destriping called from an SQL text over a table, a block a partition."""
    L.register(spark)
    rows = views.signal(spark, d).select("block", "channel", "shank", "samples")
    rows.join(_probe(spark).select(F.col("ind").alias("channel"), "sample_shift"), "channel").createOrReplaceTempView("tracelake_blocks")
    out = spark.sql("SELECT block, channel, shank, posexplode(samples) AS (sample, v) FROM signal_destripe(TABLE(tracelake_blocks) PARTITION BY block, fs => 30000D, k_filter => false)")
    return out.withColumns({"sample": F.col("sample").cast("long"), "v": F.round("v", 6) + F.lit(0.0)})


@query(SIGNAL_SQL["bad_channel_labels"])
def sql_bad_channels(spark, d):
    """Labels and features of channels by a table function."""
    L.register(spark)
    views.signal(spark, d).select("block", "channel", "samples").createOrReplaceTempView("tracelake_raw")
    out = spark.sql("SELECT * FROM signal_bad_channels(TABLE(tracelake_raw) PARTITION BY block, fs => 30000D)")
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("rms_raw", "xcor_hf", "xcor_lf", "psd_hf")})


def _bands(spark, d):
    rows = views.signal(spark, d).select("block", "channel", "shank", "samples")
    return jobs.raw_table(rows, rows, 30000, 2500, _probe(spark))


@query()
def raw_table(spark, d):
    """Raw metrics of both bands by snippet and channel; the signal stands for each."""
    out = _bands(spark, d)
    return out.withColumns({c: F.round(c, 3) + F.lit(0.0) for c, kind in out.dtypes if kind == "double"})


@query(
    recursive(f"""{_LABELS}, lv AS (SELECT block, channel, avg(v) * 1e6 AS dc, sqrt(avg(v * v)) * 1e6 AS raw FROM sig GROUP BY 1, 2), bt AS (SELECT block, channel, sqrt(avg(v * v)) * 1e6 AS butter FROM hp GROUP BY 1, 2)
SELECT block AS snippet, channel, round(dc, 3) + 0.0 AS ap_dc_offset, round(raw, 3) AS ap_raw_rms, round(butter, 3) AS ap_butter_rms, label AS ap_channel_labels, round(xcor_hf, 6) + 0.0 AS ap_xcor_hf_raw, round(xcor_lf, 6) + 0.0 AS ap_xcor_lf_raw
FROM labelled JOIN lv USING (block, channel) JOIN bt USING (block, channel)""")
)
def raw_table_levels(spark, d):
    """Those columns of the upper band's raw metrics that need no spatial filter."""
    out = _bands(spark, d)
    digits = {"ap_dc_offset": 3, "ap_raw_rms": 3, "ap_butter_rms": 3, "ap_xcor_hf_raw": 6, "ap_xcor_lf_raw": 6}
    return out.select("snippet", "channel", "ap_channel_labels", *((F.round(c, n) + F.lit(0.0)).alias(c) for c, n in digits.items()))
