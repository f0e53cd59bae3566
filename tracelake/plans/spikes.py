"""Queries on probes, events, spikes and waveforms, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import views
from ..functions import columns as C
from ..functions import kernels as K
from ..operators import clocks as CL
from ..operators import events as E
from ..operators import geometry as G
from ..operators import waveforms as X
from ..operators import windows as W
from ..sources import metadata as M
from ..views import SERIES, SPIKES, WAVES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# --- probes ------------------------------------------------------------------------
def _header_sql(n, row, col, shank, grid, adc_size, cycles, i="i"):
    dx, x0, dy, y0 = grid
    return f"""WITH g AS (SELECT i AS ind, ({row})::DOUBLE AS row, ({col})::DOUBLE AS col, ({shank})::DOUBLE AS shank FROM range({n}) t(i))
SELECT ind, row, col, shank, col * {dx}::DOUBLE + {x0} AS x, row * {dy}::DOUBLE + {y0} AS y,
       ((ind // {adc_size * 2}) * 2 + ind % 2)::DOUBLE AS adc, round((ind % {adc_size * 2} // 2) / {cycles}::DOUBLE, 9) AS sample_shift FROM g"""


_HEADERS = {
    "trace_header_np1": ("1", 1, _header_sql(384, "i // 2", "[2, 0, 3, 1][(i % 4 + 1)::INT]", "0", (16, 11, 20, 20), 12, 13)),
    "trace_header_np2_1": ("2.1", 1, _header_sql(384, "i // 2", "i % 2", "0", (32, 27, 15, 20), 16, 16)),
    "trace_header_np2_4": ("2.4", 4, _header_sql(384, "i % 48 // 2 + 24 * [0, 0, 1, 1, 0, 0, 1, 1][(i // 48 + 1)::INT]", "i % 2", "[0, 1, 0, 1, 2, 3, 2, 3][(i // 48 + 1)::INT]", (32, 27, 15, 20), 16, 16)),
    "trace_header_npultra": ("NPultra", 1, _header_sql(384, "i // 8", "i % 8", "0", (6, 0, 6, 0), 12, 13)),
    "trace_header_np2qb": ("NP2QB", 1, _header_sql(1536, "i % 384 // 2", "i % 2", "i // 384", (32, 27, 15, 20), 16, 16)),
    "trace_header_nhplong": ("NHPlong", 1, _header_sql(384, "i // 2", "[2, 0, 3, 1][(i % 4 + 1)::INT]", "0", (43.5, 27, 15, 20), 12, 13)),
}
for _name, (_version, _shanks, _sql) in _HEADERS.items():
    query(_sql, _name)(lambda spark, d, v=_version, s=_shanks: rounded(G.trace_header(spark, v, s), "sample_shift", digits=9))

_NP1 = "g AS (SELECT i AS ind, (i // 2)::DOUBLE AS row, [2, 0, 3, 1][(i % 4 + 1)::INT]::DOUBLE AS col FROM range(384) t(i)), s AS (SELECT *, col * 16 + 11 AS x, row * 20 + 20 AS y FROM g)"


@query(f"WITH {_NP1} SELECT ind, x, y, (x - 11) / 16 AS col_back, (y - 20) / 20 AS row_back FROM s")
def rc_round_trip(spark, d):
    row, col = G.to_grid(F.col("x"), F.col("y"))
    return G.layout(spark).select("ind", "x", "y", col.alias("col_back"), row.alias("row_back"))


@query(f"WITH {_NP1} SELECT ind, x, y FROM s WHERE ind NOT IN (36, 75, 112, 151, 188, 227, 264, 303, 340, 379)")
def legacy_sites(spark, d):
    return G.legacy_sites(spark).select("ind", "x", "y")


@query(f"WITH {_NP1} SELECT ind, row_number() OVER (ORDER BY row, col DESC) - 1 AS position FROM s")
def sorted_geometry(spark, d):
    return G.sorted_geometry(G.layout(spark)).select("ind", "position")


@query("SELECT i AS ind, (i % 48 // 2 + 24 * [0, 0, 1, 1, 0, 0, 1, 1][(i // 48 + 1)::INT])::DOUBLE AS row FROM range(384) t(i) WHERE [0, 1, 0, 1, 2, 3, 2, 3][(i // 48 + 1)::INT] = 2")
def split_shank(spark, d):
    return G.split_shanks(G.layout(spark, "2.4", 4), 2).select("ind", "row")


@query(f"""WITH {_NP1}, e AS (SELECT a.ind AS channel, b.ind AS neighbour FROM s a JOIN s b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 40000)
SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY neighbour) - 1 AS slot, neighbour FROM e""")
def channel_neighbours(spark, d):
    return G.neighbours(G.layout(spark))


@query(f"""WITH {_NP1}, e AS (SELECT a.ind AS channel, list(b.ind ORDER BY b.ind) AS n FROM s a JOIN s b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 40000 GROUP BY 1),
w AS (SELECT max(len(n)) AS w FROM e)
SELECT channel, array_to_string(n || list_transform(range(w - len(n)), lambda i: 384), ',') AS neighbours FROM e, w""")
def padded_neighbours(spark, d):
    return G.padded_neighbours(G.neighbours(G.layout(spark)), 384).select("channel", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("SELECT '0:10,50:50,60:90,384' AS subset")
def subset_rle(spark, d):
    ids = spark.range(385).where("(id <= 10) OR id = 50 OR (id BETWEEN 60 AND 90) OR id = 384").withColumnRenamed("id", "channel")
    return G.ranges_text(ids)


@query("SELECT i AS channel FROM range(385) t(i) WHERE i <= 10 OR i = 50 OR i BETWEEN 60 AND 90 OR i = 384")
def subset_expand(spark, d):
    return G.ranges_expanded(spark.createDataFrame([("0:10,50:50,60:90,384",)], "subset string"))


@query("SELECT * FROM (VALUES ('camera', 2::BIGINT), ('frame', 4::BIGINT), ('bpod', 18::BIGINT)) t(device, channel)")
def sync_map(spark, d):
    rows = [("3A", {"pin03": "camera", "pin06": "frame", "pin05": ""}, {"AI2": "bpod"})]
    return G.sync_map(spark.createDataFrame(rows, "system string, digital map<string,string>, analog map<string,string>"))


_META = """typeThis=imec
imDatPrb_type=24
imDatPrb_sn=19011110513
imSampRate=29999.757983
nSavedChans=385
snsApLfSy=384,0,1
imAiRangeMax=0.5
imMaxInt=8192
fileTimeSecs=10.5
~snsShankMap=(1,2,480)(0:0:0:1)(0:1:0:1)(1:0:3:0)"""


@query("""SELECT 'NP2.4' AS version, '2' AS major, 19011110513::BIGINT AS serial, 29999.757983::DOUBLE AS fs, 'ap' AS band, 8192.0::DOUBLE AS max_int,
314997::BIGINT AS ns, 1::BIGINT AS n_sync, 3::BIGINT AS n_sites, 1::BIGINT AS last_shank""")
def meta_parse(spark, d):
    lines = spark.createDataFrame([("a", x) for x in _META.split("\n")], "path string, value string")
    one = M.parse(lines)
    m = F.col("meta")
    v = M.version(m)
    facts = one.select("path", v.alias("version"), M.major_version(v).alias("major"), M.serial(m).alias("serial"), M.rate(m).alias("fs"), M.band(m).alias("band"), M.max_int(m).alias("max_int"), M.samples(m).alias("ns"), F.size(M.sync_channels(m)).cast("long").alias("n_sync"))
    sites = M.sites(one).groupBy("path").agg(F.count(F.lit(1)).alias("n_sites"), F.max("shank").alias("last_shank"))
    return facts.join(sites, "path").drop("path")


def _meta_rows(spark):
    sites = "".join(f"(0:{i % 2}:{i // 2}:1)" for i in range(8))
    um = "".join(f"({i // 4}:{27 + 32 * (i % 2)}:{15 * (i % 4 // 2)}:1)" for i in range(8))
    gains = "".join(f"({i} 0 0 {500 + i} 250 1)" for i in range(8))
    files = {
        "one": f"typeThis=imec\nimDatPrb_type=0\nimAiRangeMax=0.6\nnSavedChans=9\nsnsApLfSy=8,0,1\n~imroTbl=(0,8){gains}\n~snsShankMap=(1,2,480){sites}",
        "two": f"typeThis=imec\nimDatPrb_type=24\nimDatPrb_pn=NP2010\nimAiRangeMax=0.5\nimMaxInt=8192\nnSavedChans=9\nsnsApLfSy=8,0,1\n~imroTbl=(24,8)(0 0 0 0 0)\n~snsGeomMap=(NP2010,4,250,70){um}",
        "board": "typeThis=nidq\nniAiRangeMax=5\nniMNGain=200\nniMAGain=50\nnSavedChans=5\nsnsMnMaXaDw=1,1,2,1",
    }
    return M.parse(spark.createDataFrame([(k, x) for k, t in files.items() for x in t.split("\n")], "path string, value string"))


@query("""SELECT 'one' AS path, i AS channel, CASE WHEN i < 8 THEN 0.6::DOUBLE / 512 / (500 + i) ELSE 1.0 END * 1e9 AS ap, CASE WHEN i < 8 THEN 0.6::DOUBLE / 512 / 250 ELSE 1.0 END * 1e9 AS lf, NULL::DOUBLE AS nidq FROM range(9) t(i)
UNION ALL SELECT 'two', i, g, g, NULL FROM (SELECT i, CASE WHEN i < 8 THEN 0.5::DOUBLE / 8192 / 80 ELSE 1.0 END * 1e9 AS g FROM range(9) t(i))
UNION ALL SELECT 'board', i, NULL, NULL, [5::DOUBLE / 32768 / 200, 5::DOUBLE / 32768 / 50, 5::DOUBLE / 32768, 5::DOUBLE / 32768, 1][(i + 1)::INT] * 1e9 FROM range(5) t(i)""")
def meta_gains(spark, d):
    """Nanovolts a bit of each saved channel of three kinds of files."""
    return M.volts_per_bit(_meta_rows(spark)).select("path", "channel", *((F.col(c) * 1e9).alias(c) for c in ("ap", "lf", "nidq")))


@query("""WITH a AS (SELECT 'one' AS path, i AS ind, 0 AS shank, i // 2 AS row, 2 - 2 * (i % 2) + (i // 2) % 2 AS col, 13 AS c FROM range(8) t(i)
UNION ALL SELECT 'two', i, i // 4, i % 4 // 2, i % 2, 16 FROM range(8) t(i)),
g AS (SELECT *, CASE WHEN c = 13 THEN col * 16.0 + 11 ELSE col * 32.0 + 27 END AS x, CASE WHEN c = 13 THEN row * 20.0 + 20 ELSE row * 15.0 + 20 END AS y FROM a)
SELECT path, ind, shank, row::DOUBLE AS row, col::DOUBLE AS col, x::DOUBLE AS x, y::DOUBLE AS y, (ind % 2)::DOUBLE AS adc, round((ind // 2) / c::DOUBLE, 9) AS sample_shift,
  row_number() OVER (PARTITION BY path ORDER BY shank, row, col DESC) - 1 AS position FROM g""")
def meta_geometry(spark, d):
    out = M.geometry(_meta_rows(spark)).drop("flag")
    return rounded(out, "sample_shift", digits=9)


@query("SELECT * FROM (VALUES ('one', '3B1', 1::BIGINT, '8', ''), ('two', 'NP2.4', 4, '8', ''), ('board', 'nidq', NULL, '4', '2,3')) t(path, version, shanks, sync, analog)")
def meta_sync(spark, d):
    m = F.col("meta")
    told = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _meta_rows(spark).select("path", M.version(m).alias("version"), M.shank_count(m).alias("shanks"), told(M.sync_channels(m)).alias("sync"), told(M.analog_sync_channels(m)).alias("analog"))


# --- windows --------------------------------------------------------------------------
_LENGTHS = "n AS (SELECT user_id AS rec, count(*) AS ns FROM events GROUP BY 1)"
_WINDOWS = f"""{_LENGTHS}, w AS (SELECT rec, ns, unnest(range(0, greatest(ceil((ns - 20) / 12.0)::BIGINT + 1, 1))) AS iw FROM n),
b AS (SELECT rec, ns, iw, iw * 12 AS first, least(iw * 12 + 20, ns) AS last FROM w)"""


def _windows(spark, d):
    lengths = views.table(spark, d, "events").groupBy(F.col("user_id").alias("rec")).agg(F.count(F.lit(1)).alias("ns"))
    return W.windows(lengths, 20, 8)


@query(f"WITH {_WINDOWS} SELECT rec, iw, first, last FROM b")
def windows_firstlast(spark, d):
    return _windows(spark, d).select("rec", "iw", "first", "last")


@query(f"WITH {_WINDOWS} SELECT rec, iw, CASE WHEN first = 0 THEN 0 ELSE first + 4 END AS valid_first, CASE WHEN last = ns THEN ns ELSE last - 4 END AS valid_last, first + 4 AS inner_first, last - 4 AS inner_last FROM b")
def windows_valid(spark, d):
    return _windows(spark, d).select("rec", "iw", "valid_first", "valid_last", "inner_first", "inner_last")


@query(f"WITH {_WINDOWS} SELECT rec, iw, round((first + (last - first - 1) / 2.0::DOUBLE) / 30, 6) AS t FROM b")
def windows_tscale(spark, d):
    return rounded(_windows(spark, d).select("rec", "iw", W.centre(F.col("first"), F.col("last"), 30).alias("t")), "t")


@query(f"""WITH {_WINDOWS}, s AS (SELECT rec, iw, ns, first, last, unnest(range(first, last)) AS sample FROM b),
g AS (SELECT *, CASE WHEN first > 0 AND sample - first + 1 <= 8 THEN (1 - cos(2 * pi() * (sample - first + 1) / 18)) / 2 ELSE 1 END
  * CASE WHEN last < ns AND last - sample <= 8 THEN (1 - cos(2 * pi() * (last - sample) / 18)) / 2 ELSE 1 END AS w FROM s)
SELECT rec, sample, round(sum(w), 6) AS weight, count(*) AS n FROM g GROUP BY 1, 2""")
def windows_splice(spark, d):
    each = _windows(spark, d).withColumn("sample", F.explode(F.sequence("first", F.col("last") - 1)))
    weight = W.splice_weight(F.col("sample"), F.col("first"), F.col("last"), F.col("ns"), 8)
    return rounded(each.groupBy("rec", "sample").agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n")), "weight")


@query(f"""WITH {SERIES}, m AS (SELECT channel, v, unnest(range(greatest(0, ceil((sample - 19) / 12.0)::BIGINT), sample // 12 + 1)) AS iw FROM series)
SELECT channel, iw, round(sqrt(avg(v * v)), 6) AS rms, count(*) AS n FROM m GROUP BY 1, 2""")
def window_rms(spark, d):
    df = W.window_members(views.series(spark, d), 20, 8)
    return rounded(df.groupBy("channel", "iw").agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count(F.lit(1)).alias("n")), "rms")


# --- events ---------------------------------------------------------------------------
@query(f"WITH {SERIES}, c AS (SELECT *, v - lag(v) OVER (PARTITION BY channel ORDER BY sample) AS p FROM series) SELECT channel, sample, round(p, 6) AS polarity FROM c WHERE abs(p) >= 40")
def fronts(spark, d):
    return rounded(E.fronts(views.series(spark, d), step=40).select("channel", "sample", "polarity"), "polarity")


@query(f"WITH {SERIES}, c AS (SELECT *, v - lag(v) OVER (PARTITION BY channel ORDER BY sample) AS p FROM series) SELECT channel, sample, round(p, 6) AS polarity FROM c WHERE abs(p) >= 40")
def fronts_over_blocks(spark, d):
    return rounded(E.fronts_blocks(X.to_blocks(views.series(spark, d), 16), 16, 40), "polarity")


@query(f"WITH {SERIES}, c AS (SELECT *, v - lag(v) OVER (PARTITION BY channel ORDER BY sample) AS p FROM series) SELECT channel, sample FROM c WHERE p >= 40")
def rises(spark, d):
    return E.rises(views.series(spark, d), step=40).select("channel", "sample")


@query(f"WITH {SERIES}, c AS (SELECT *, v - lag(v) OVER (PARTITION BY channel ORDER BY sample) AS p FROM series) SELECT channel, sample FROM c WHERE -p >= 40")
def falls(spark, d):
    return E.rises(views.series(spark, d), step=40, falling=True).select("channel", "sample")


@query(f"WITH {SERIES}, c AS (SELECT *, (v > 60)::INT - lag((v > 60)::INT) OVER (PARTITION BY channel ORDER BY sample) AS p FROM series) SELECT channel, sample FROM c WHERE p = 1")
def rises_analog(spark, d):
    return E.rises(views.series(spark, d), step=60, analog=True).select("channel", "sample")


@query("WITH w AS (SELECT event_id, i, (event_id >> i) & 1 AS b FROM events, range(16) r(i)) SELECT event_id, array_to_string(list(b ORDER BY i), '') AS bits FROM w GROUP BY 1")
def split_sync(spark, d):
    return views.table(spark, d, "events").select("event_id", F.array_join(F.transform(C.bits(F.col("event_id")), lambda x: x.cast("string")), "").alias("bits"))


@query("""WITH w AS (SELECT event_id // 8 AS rec, event_id AS sample, i AS channel, ((event_id * 7 // 3) >> i) & 1 AS b FROM events, range(16) r(i)),
f AS (SELECT *, b - lag(b) OVER (PARTITION BY channel ORDER BY sample) AS p FROM w)
SELECT round(sample / 30000.0::DOUBLE, 9) AS time, channel, p AS polarity FROM f WHERE p <> 0""")
def sync_extract(spark, d):
    words = views.table(spark, d, "events").select(F.col("event_id").alias("sample"), F.floor(F.col("event_id") * 7 / 3).alias("word"))
    out = E.sync_fronts(words, 30000)
    return rounded(out.select("time", F.col("channel").cast("long").alias("channel"), F.col("polarity").cast("long").alias("polarity")), "time", digits=9)


@query("""WITH s AS (SELECT user_id AS channel, event_id // 1000 AS "window", event_id AS sample, value AS v FROM events),
f AS (SELECT channel, "window", quantile_cont(v, 0.1) AS fl FROM s GROUP BY 1, 2)
SELECT channel, "window", sample, (v - fl >= 25)::BIGINT AS bit FROM s JOIN f USING (channel, "window")""")
def analog_sync(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").alias("channel"), F.floor(F.col("event_id") / 1000).alias("window"), F.col("event_id").alias("sample"), F.col("value").alias("v"))
    return E.analog_lines(e, 25).select("channel", "window", "sample", F.col("bit").cast("long").alias("bit"))


_SATURATION = """sat AS (SELECT block, channel, sample, v, lead(v) OVER (PARTITION BY block, channel ORDER BY sample) AS nx FROM sig),
f AS (SELECT block, sample, avg((abs(v) > 0.96 * 0.3)::INT) > 0.06 OR avg(coalesce(abs(nx - v) / 2 >= 0.16, false)::INT) > 0.06 AS saturated FROM sat GROUP BY 1, 2)"""


def _saturation(spark, d):
    return E.saturation_blocks(views.signal(spark, d), 0.3, 2, 0.16, 0.06, alone=True)


@query(f"WITH {views.SIGNAL}, {_SATURATION} SELECT block, sample, saturated FROM f")
def saturation(spark, d):
    out = _saturation(spark, d).select("block", F.posexplode("saturated").alias("sample", "saturated"))
    return out.withColumn("sample", F.col("sample").cast("long"))


@query(f"""WITH {views.SIGNAL}, {_SATURATION}, m AS (SELECT a.block, a.sample, sum(b.saturated::INT * sin(pi() / 7 * (b.sample - a.sample + 3.5))) AS t
  FROM f a JOIN f b ON a.block = b.block AND abs(a.sample - b.sample) <= 3 GROUP BY 1, 2)
SELECT block, sample, round(greatest(0, 1 - t), 6) + 0.0 AS mute FROM m""")
def mute(spark, d):
    out = E.mute_blocks(_saturation(spark, d), alone=True).select("block", F.posexplode("mute").alias("sample", "mute"))
    return rounded(out.withColumn("sample", F.col("sample").cast("long")), "mute")


@query(f"""WITH {SERIES}, f AS (SELECT channel, sample, v > 60 AS s, lag(v > 60, 1, false) OVER w AS ps, lead(sample) OVER w AS nx, max(sample) OVER (PARTITION BY channel) AS e FROM series WINDOW w AS (PARTITION BY channel ORDER BY sample)),
r AS (SELECT *, sum((s AND NOT ps)::INT) OVER (PARTITION BY channel ORDER BY sample) AS run FROM f)
SELECT channel, min(sample) AS start_sample, max(coalesce(nx, e)) AS stop_sample FROM r WHERE s GROUP BY channel, run""")
def saturation_intervals(spark, d):
    df = views.series(spark, d).withColumn("saturated", F.col("v") > 60)
    return E.intervals(df, keys=("channel",))


_VENN = """b AS (SELECT sample // 3600 AS t, channel // 4 AS c, {counts} FROM spikes GROUP BY 1, 2),
k AS (SELECT *, unnest(range(1, greatest({names}) + 1)) AS k FROM b)
SELECT {mask} AS mask, count(*) AS n FROM k WHERE greatest({names}) > 0 GROUP BY 1"""


def _venn_sql(sorters):
    names = [f"n{i}" for i in range(len(sorters))]
    return f"WITH {SPIKES}, " + _VENN.format(counts=", ".join(f"count(*) FILTER (sorter = '{s}') AS {n}" for s, n in zip(sorters, names, strict=True)), names=", ".join(names), mask=" || ".join(f"CASE WHEN {n} >= k THEN '1' ELSE '0' END" for n in names))


@query(_venn_sql(["view", "click"]))
def spikes_venn2(spark, d):
    return E.spike_venn(views.spikes(spark, d), ["view", "click"], samples_bin=3600)


@query(_venn_sql(["view", "click", "purchase"]))
def spikes_venn3(spark, d):
    return E.spike_venn(views.spikes(spark, d), ["view", "click", "purchase"], samples_bin=3600)


@query(f"""WITH {SPIKES}, lo AS (SELECT min(sample) AS lo FROM spikes WHERE sorter IN ('view', 'click')),
a AS (SELECT DISTINCT (sample - lo) // 600 AS bin FROM spikes, lo WHERE sorter = 'view'), b AS (SELECT DISTINCT (sample - lo) // 600 AS bin FROM spikes, lo WHERE sorter = 'click'),
g AS (SELECT a.bin - b.bin AS lag, count(*) AS n FROM a, b GROUP BY 1)
SELECT lag, n FROM g ORDER BY n DESC, lag LIMIT 1""")
def sync_lag(spark, d):
    both = views.spikes(spark, d).where(F.col("sorter").isin("view", "click"))
    clocks = both.select(F.lit(0).cast("long").alias("rec"), F.when(F.col("sorter") == "view", "a").otherwise("b").alias("side"), F.col("sample").cast("double").alias("time"))
    return CL.clock_lag(clocks, 600.0).select("lag", "n")


@query("""WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view')
SELECT p.event_id, coalesce(v.event_id, -1) AS before FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_prev(spark, d):
    e = views.table(spark, d, "events").where(F.col("event_type").isin("purchase", "view"))
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("before", seen).where("event_type = 'purchase'").select("event_id", F.coalesce("before", F.lit(-1)).alias("before"))


@query("""WITH e AS (SELECT user_id AS rec, epoch_us(ts) / 1e6::DOUBLE AS a FROM events), c AS (SELECT rec, a - min(a) OVER (PARTITION BY rec) AS a FROM e)
SELECT rec, round(regr_slope(a * 1.00001714 + 34.323, a), 9) AS slope, round(regr_intercept(a * 1.00001714 + 34.323, a), 4) AS offset_s FROM c GROUP BY 1""")
def sync_linear_fit(spark, d):
    e = views.table(spark, d, "events").select(F.col("user_id").alias("rec"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("a"))
    e = e.withColumn("a", F.col("a") - F.min("a").over(Window.partitionBy("rec")))
    b = F.col("a") * 1.00001714 + 34.323
    return e.groupBy("rec").agg(F.round(F.regr_slope(b, F.col("a")), 9).alias("slope"), F.round(F.regr_intercept(b, F.col("a")), 4).alias("offset_s"))


@query("""WITH e AS (SELECT user_id AS rec, epoch_us(ts) / 1e6::DOUBLE - 1704067200 AS t FROM events),
f AS (SELECT rec, t, t * 1.000001 + 3.0 AS u FROM e)
SELECT rec, round(t, 6) AS time_a, round(u, 6) AS time_b, round((regr_slope(u, t) OVER (PARTITION BY rec) - 1) * 1e6, 1) AS drift_ppm FROM f""")
def sync_match(spark, d):
    """Each event of a clock with its own image in another that runs apart by a millionth, three seconds late."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    e = views.table(spark, d, "events").select(F.col("user_id").alias("rec"), t.alias("time"))
    both = e.withColumn("side", F.lit("a")).unionByName(e.select("rec", (F.col("time") * 1.000001 + 3.0).alias("time"), F.lit("b").alias("side")))
    return CL.clock_pairs(both, views.folder(spark, "clocks"), 10.0).select("rec", *(F.round(c, k).alias(c) for c, k in (("time_a", 6), ("time_b", 6), ("drift_ppm", 1))))


# --- spike tables and waveforms ----------------------------------------------------------
_TABLE = f"""{SPIKES}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(spike::VARCHAR || ':0'), spike) AS k FROM spikes WHERE sample >= 0 AND sample > 42 AND sample < 2500000 - 86),
t AS (SELECT sample, cluster, channel, sorter, spike FROM r WHERE k <= 50),
x AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sample, spike) - 1 AS index_within_clusters, row_number() OVER (ORDER BY cluster, sample, spike) - 1 AS waveform_index FROM t)"""


def _table(spark, d):
    return X.waveform_table(views.spikes(spark, d), 2_500_000, 50)


@query(f"WITH {_TABLE} SELECT spike, sample, cluster, channel, index_within_clusters, waveform_index FROM x")
def wfs_table(spark, d):
    return _table(spark, d).select("spike", "sample", "cluster", "channel", "index_within_clusters", "waveform_index")


@query(f"WITH {_TABLE} SELECT cluster, count(*) AS count, min(waveform_index) AS first_index, max(waveform_index) AS last_index FROM x GROUP BY 1")
def cluster_summary(spark, d):
    return X.cluster_summary(_table(spark, d))


@query(f"WITH {SPIKES} SELECT spike, sample, sample // 30000 AS block FROM spikes")
def spikes_to_blocks(spark, d):
    return X.blocks_of(views.spikes(spark, d), 30000).select("spike", "sample", "block")


_EXTRACT = f"""{SERIES}, sp AS (SELECT channel * 1000000 + sample AS spike, channel, sample FROM series),
g AS (SELECT DISTINCT channel FROM series), e AS (SELECT a.channel, b.channel AS neighbour, row_number() OVER (PARTITION BY a.channel ORDER BY b.channel) - 1 AS slot FROM g a JOIN g b ON abs(a.channel - b.channel) <= 1),
q AS (SELECT spike, slot, neighbour, sample, i FROM sp JOIN e USING (channel), range(8) r(i)),
w AS (SELECT q.spike, q.slot, q.neighbour, q.i, coalesce(s.v, -1) AS v FROM q LEFT JOIN series s ON s.channel = q.neighbour AND s.sample = q.sample - 4 + q.i)"""


def _edges(spark, d):
    ids = views.series(spark, d).select("channel").distinct()
    near = ids.select("channel", F.explode(F.array(F.col("channel") - 1, F.col("channel"), F.col("channel") + 1)).alias("neighbour"))
    kept = near.join(ids.withColumnRenamed("channel", "neighbour"), "neighbour", "left_semi")
    return kept.select("channel", "neighbour", (F.row_number().over(Window.partitionBy("channel").orderBy("neighbour")) - 1).cast("long").alias("slot"))


def _extract(spark, d):
    s = views.series(spark, d)
    spikes = s.select((F.col("channel") * 1000000 + F.col("sample")).alias("spike"), "channel", "sample")
    return X.extract(spikes, X.to_blocks(s, 100), _edges(spark, d), 4, 8, 100, -1.0)


@query(f"WITH {_EXTRACT} SELECT spike, slot, neighbour, round(sum(v), 6) AS total, round(max(CASE WHEN i = 4 THEN v END), 6) AS at_peak FROM w GROUP BY 1, 2, 3")
def extract_waveforms(spark, d):
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rounded(_extract(spark, d).select("spike", "slot", "neighbour", total.alias("total"), F.col("samples")[4].alias("at_peak")), "total", "at_peak")


@query(f"WITH {WAVES}, k AS (SELECT waveform_index, cluster, row_number() OVER (PARTITION BY cluster ORDER BY waveform_index) - 1 AS i FROM (SELECT DISTINCT waveform_index, cluster FROM wave)) SELECT waveform_index, cluster, i AS index_within_clusters FROM k WHERE cluster IN (1, 3) AND i IN (0, 2, 4)")
def load_waveforms(spark, d):
    w = Window.partitionBy("cluster").orderBy("waveform_index")
    df = views.waveforms(spark, d).withColumn("index_within_clusters", (F.row_number().over(w) - 1).cast("long"))
    labels, places = spark.createDataFrame([(1,), (3,)], "cluster long"), spark.createDataFrame([(0,), (2,), (4,)], "index_within_clusters long")
    return X.load(df, labels, places).select("waveform_index", "cluster", "index_within_clusters")


def _cells(spark, d):
    df = views.waveforms(spark, d).select("waveform_index", "cluster", F.posexplode("traces").alias("trace", "samples"))
    return df.select("waveform_index", "cluster", F.col("trace").cast("long").alias("trace"), F.posexplode("samples").alias("sample", "v")).withColumn("sample", F.col("sample").cast("long"))


@query(f"WITH {WAVES} SELECT cluster, trace, t AS sample, round(median(v), 6) + 0.0 AS template, count(*) AS fold FROM wave GROUP BY 1, 2, 3")
def median_templates(spark, d):
    return rounded(X.templates(_cells(spark, d)), "template")


@query(f"WITH {WAVES}, r AS (SELECT *, row_number() OVER (PARTITION BY waveform_index, trace ORDER BY abs(v) DESC, t) AS k FROM wave) SELECT waveform_index, trace, t AS time_idx, abs(v) AS max_abs, v AS val FROM r WHERE k = 1")
def pick_maxima(spark, d):
    df = views.waveforms(spark, d).select("waveform_index", F.posexplode("traces").alias("trace", "samples"))
    return X.maxima(df).withColumn("trace", F.col("trace").cast("long"))


@query(f"WITH {WAVES}, r AS (SELECT *, row_number() OVER (PARTITION BY waveform_index ORDER BY abs(v) DESC, trace, t) AS k FROM wave) SELECT waveform_index, trace AS peak_trace_idx, t AS peak_time_idx, v AS peak_val FROM r WHERE k = 1")
def pick_maximum(spark, d):
    return X.maximum(views.waveforms(spark, d))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, x, list_position(x, list_max(x)) AS p FROM e),
c AS (SELECT vec_id, p, x[p] AS v1, CASE WHEN p IN (1, 64) THEN NULL ELSE x[p - 1] END AS v0, CASE WHEN p IN (1, 64) THEN NULL ELSE x[p + 1] END AS v2 FROM m),
q AS (SELECT *, (v0 - 2 * v1 + v2) / 2 AS a, (v2 - v0) / 2 AS b FROM c), z AS (SELECT *, -b / (2 * CASE WHEN a = 0 THEN 0.5 ELSE a END) AS ip FROM q)
SELECT vec_id, round(coalesce(p - 1 + ip, p - 1), 6) AS place, round(coalesce(v1 + ip * b + ip * ip * a, v1), 6) AS top FROM z""")
def parabolic_max(spark, d):
    e = views.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return rounded(e.withColumn("m", X.parabolic_maximum(F.col("x"))).select("vec_id", F.col("m.i").alias("place"), F.col("m.v").alias("top")), "place", "top")


def _ramp(x, a, b):
    return f"(CASE WHEN {x} <= {a} THEN 0 WHEN {x} >= {b} THEN 1 ELSE (1 - cos(({x} - {a}) / ({b} - {a})::DOUBLE * pi())) / 2 END)"


_FEATURES = f"""WITH {WAVES}, tp AS (SELECT waveform_index AS w, trace, t, v * {_ramp('t', 0, 5)} * (1 - {_ramp('t', 11, 16)}) AS v FROM wave),
pk AS (SELECT w, trace AS ptr, t AS pt, v AS pv FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY abs(v) DESC, trace, t) AS k FROM tp) WHERE k = 1),
ar AS (SELECT tp.w, tp.t, tp.v, pk.ptr, pk.pt, pk.pv, -sign(pk.pv) AS s FROM tp JOIN pk ON tp.w = pk.w AND tp.trace = pk.ptr),
tr AS (SELECT w, t AS tt, v AS tv FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY v * s DESC, t) AS k FROM ar WHERE t >= pt) WHERE k = 1),
sw AS (SELECT pk.*, tr.tt, tr.tv, coalesce(pv > 0 AND abs(pv / nullif(tv, 0)) <= 1.5, false) AS swap FROM pk JOIN tr USING (w)),
p2 AS (SELECT w, ptr, swap, CASE WHEN swap THEN tt ELSE pt END AS pt, CASE WHEN swap THEN tv ELSE pv END AS pv, CASE WHEN swap THEN -sign(tv) ELSE -sign(pv) END AS s FROM sw),
a2 AS (SELECT ar.w, ar.t, ar.v, p2.ptr, p2.pt, p2.pv, p2.s, ar.v * CASE WHEN swap THEN 1 ELSE p2.s END AS a FROM ar JOIN p2 USING (w)),
t2 AS (SELECT w, t AS tt, v AS tv FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY v * s DESC, t) AS k FROM a2 WHERE t >= pt) WHERE k = 1),
ti AS (SELECT w, t AS tip, a * s AS tipv FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY a DESC, t) AS k FROM a2 WHERE t < pt) WHERE k = 1),
hp AS (SELECT w, coalesce(min(t) FILTER (t >= pt AND a - pv / 2 * s > 0), 0) AS post, coalesce(max(t) FILTER (t < pt AND a - pv / 2 * s > 0), 15) AS pre FROM a2 GROUP BY 1),
z AS (SELECT p2.w, p2.ptr, p2.pt, p2.pv, p2.s, t2.tt, t2.tv, ti.tip, ti.tipv, hp.post, hp.pre, least(t2.tt + 5, 15) AS rec FROM p2 JOIN t2 USING (w) LEFT JOIN ti USING (w) JOIN hp USING (w)),
y AS (SELECT z.*, (SELECT a * a2.s FROM a2 WHERE a2.w = z.w AND a2.t = z.post) AS postv, (SELECT a * a2.s FROM a2 WHERE a2.w = z.w AND a2.t = z.pre) AS prev, (SELECT a * a2.s FROM a2 WHERE a2.w = z.w AND a2.t = z.rec) AS recv FROM z)
SELECT w AS waveform_index, ptr AS peak_trace_idx, pt AS peak_time_idx, round(pv, 6) + 0.0 AS peak_val, s::DOUBLE AS invert_sign_peak, tt AS trough_time_idx, round(tv, 6) + 0.0 AS trough_val,
round(abs(pv / nullif(tv, 0)), 4) AS peak_to_trough_ratio, round(ln(abs(pv / nullif(tv, 0))), 4) + 0.0 AS peak_to_trough_ratio_log, tip AS tip_time_idx, round(tipv, 6) + 0.0 AS tip_val,
round((tt - pt) / 30000.0::DOUBLE, 9) AS peak_to_trough_duration, post AS half_peak_post_time_idx, pre AS half_peak_pre_time_idx, round(postv, 6) + 0.0 AS half_peak_post_val, round(prev, 6) + 0.0 AS half_peak_pre_val,
round((post - pre) / 30000.0::DOUBLE, 9) + 0.0 AS half_peak_duration, rec AS recovery_time_idx, round(recv, 6) + 0.0 AS recovery_val,
round((pv - tipv) / nullif((pt - tip) / 30000.0::DOUBLE, 0), 3) + 0.0 AS depolarisation_slope, round((tv - pv) / nullif((tt - pt) / 30000.0::DOUBLE, 0), 3) + 0.0 AS repolarisation_slope,
round((recv - tv) / nullif((rec - tt) / 30000.0::DOUBLE, 0), 3) + 0.0 AS recovery_slope FROM y"""


@query(_FEATURES)
def spike_features(spark, d):
    out = X.features(views.waveforms(spark, d), length=16)
    out = rounded(out, "peak_val", "trough_val", "tip_val", "half_peak_post_val", "half_peak_pre_val", "recovery_val")
    out = rounded(out, "peak_to_trough_ratio", "peak_to_trough_ratio_log", digits=4)
    out = rounded(out, "peak_to_trough_duration", "half_peak_duration", digits=9)
    return rounded(out, "depolarisation_slope", "repolarisation_slope", "recovery_slope", digits=3)


@query(f"""WITH {WAVES}, r AS (SELECT *, row_number() OVER (PARTITION BY waveform_index, trace ORDER BY abs(v) DESC, t) AS k FROM wave), m AS (SELECT * FROM r WHERE k = 1),
p AS (SELECT waveform_index, trace AS peak FROM (SELECT *, row_number() OVER (PARTITION BY waveform_index ORDER BY abs(v) DESC, trace) AS j FROM m) WHERE j = 1),
g AS (SELECT i AS ind, [43, 11, 59, 27][(i + 1)::INT]::DOUBLE AS x, (i // 2)::DOUBLE * 20 + 20 AS y FROM range(4) t(i))
SELECT waveform_index, round(sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) * v) / nullif(sum(v), 0), 4) + 0.0 AS spread
FROM m JOIN p USING (waveform_index) JOIN g a ON a.ind = m.trace JOIN g b ON b.ind = p.peak GROUP BY 1""")
def spatial_spread(spark, d):
    return rounded(X.spatial_spread(views.waveforms(spark, d), G.layout(spark, channels=4)), "spread", digits=4)


@query(f"""WITH {_NP1}, sp AS (SELECT event_id AS spike, event_id % 384 AS channel FROM events),
e AS (SELECT a.ind AS channel, b.ind AS neighbour FROM s a JOIN s b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1600), k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY neighbour) - 1 AS slot FROM e)
SELECT sp.spike, k.slot, k.neighbour, s.x, s.y FROM sp JOIN k USING (channel) JOIN s ON s.ind = k.neighbour""")
def waveform_coordinates(spark, d):
    geometry = G.layout(spark)
    spikes = views.table(spark, d, "events").select(F.col("event_id").alias("spike"), F.pmod("event_id", F.lit(384)).alias("channel"))
    return X.coordinates(spikes, G.neighbours(geometry, 40.0), geometry)


# --- small functions ------------------------------------------------------------------------
@query(f"SELECT i, round({_ramp('i', 10, 30)}, 9) AS gain FROM range(50) t(i)")
def cosine_ramp(spark, d):
    return rounded(spark.range(50).select(F.col("id").alias("i"), C.cosine_ramp(F.col("id").cast("double"), 10, 30).alias("gain")), "gain", digits=9)


@query("SELECT i, round(2 / (sqrt(3 * 4.0) * pi() ** 0.25) * (1 - ((i - 49.5) / 4.0) ** 2) * exp(-((i - 49.5) ** 2) / 32.0), 9) + 0.0 AS v FROM range(100) t(i)")
def ricker(spark, d):
    one = spark.range(1).select(F.posexplode(C.ricker(F.lit(100), F.lit(4.0))).alias("i", "v"))
    return rounded(one.select(F.col("i").cast("long").alias("i"), "v"), "v", digits=9)


@query("SELECT n, (SELECT min((2 ** p * 3 ** q)::BIGINT) FROM range(25) a(p), range(15) b(q) WHERE 2 ** p * 3 ** q >= n) AS fast FROM (SELECT unnest(range(1, 5000, 37)) AS n)")
def fast_length(spark, d):
    return spark.range(1, 5000, 37).select(F.col("id").alias("n"), C.next_fast_length(F.col("id")).cast("long").alias("fast"))


@query("SELECT n.n, k.k, round(k.k / n.n / 0.002::DOUBLE, 6) AS f FROM (SELECT unnest([8, 9, 500]) AS n) n, range(251) k(k) WHERE k.k <= n.n // 2")
def fscale(spark, d):
    n = spark.createDataFrame([(8,), (9,), (500,)], "n int")
    return rounded(n.select("n", F.posexplode(C.frequencies(F.col("n"), F.lit(0.002))).alias("k", "f")).withColumn("k", F.col("k").cast("long")), "f")


@query(f"""WITH {SERIES}, w AS (SELECT a.channel, a.sample, any_value(a.v) AS v, sum(coalesce(b.v, 0)) / 25 AS m FROM series a LEFT JOIN series b ON a.channel = b.channel AND abs(a.sample - b.sample) <= 12 GROUP BY 1, 2)
SELECT channel, sample, round(m, 6) AS mean FROM w""")
def moving_average25(spark, d):
    w = Window.partitionBy("channel").orderBy("sample").rowsBetween(-12, 12)
    return rounded(views.series(spark, d).select("channel", "sample", (F.sum("v").over(w) / 25).alias("mean")), "mean")


def _rolling_sql(weights):
    n = len(weights)
    h = n // 2
    return f"""WITH {SERIES}, n AS (SELECT channel, count(*) AS n FROM series GROUP BY 1), o AS (SELECT s.channel, s.sample, n.n, i, s.sample + i - {h} AS j FROM series s JOIN n USING (channel), range({n}) r(i) WHERE n.n > {n}),
p AS (SELECT channel, sample, i, CASE WHEN j < 0 THEN -j WHEN j >= n THEN 2 * (n - 1) - j ELSE j END AS j FROM o)
SELECT p.channel, p.sample, round(sum(s.v * {[float(w) for w in weights]}[(i + 1)::INT]), 6) + 0.0 AS v FROM p JOIN series s ON s.channel = p.channel AND s.sample = p.j GROUP BY 1, 2"""


def _rolling(spark, d, kind):
    """Reflected series under a normalised window: arrays of a series, one row each."""
    w = K.smoothing_window(kind, 11)
    s = views.series(spark, d)
    rows = s.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "v"))), lambda x: x["v"]).alias("x")).where(F.size("x") > 11)
    head, tail = F.reverse(F.slice("x", 2, 5)), F.reverse(F.slice("x", F.size("x") - 5, F.lit(5)))
    rows = rows.withColumn("y", F.concat(head, F.col("x"), tail))
    made = F.transform("x", lambda _, i: sum((F.get(F.col("y"), i + k) * float(w[k]) for k in range(11)), F.lit(0.0)))
    return rounded(rows.select("channel", F.posexplode(made).alias("sample", "v")).withColumn("sample", F.col("sample").cast("long")), "v")


@query(_rolling_sql(K.smoothing_window("flat", 11)))
def rolling_flat(spark, d):
    return _rolling(spark, d, "flat")


@query(_rolling_sql(K.smoothing_window("blackman", 11)))
def rolling_blackman(spark, d):
    return _rolling(spark, d, "blackman")


# --- without SQL ---------------------------------------------------------------------------
@query()
def shift_waveforms(spark, d):
    """Waveforms of each cluster moved onto its median template by correlation."""
    out = X.shifted(views.waveforms(spark, d), _cells(spark, d))
    return out.select("waveform_index", "cluster", F.round("lag", 6).alias("lag"), F.posexplode("traces").alias("trace", "samples"))


@query()
def phase_shifts(spark, d):
    out = X.shifted(views.waveforms(spark, d), _cells(spark, d), fs=30000)
    return out.select("waveform_index", F.round("lag", 6).alias("lag"))


@query("""WITH g AS (SELECT (i1 * 5 + i2) * 8 + j1 * 4 + j2 AS place, i1 + 1 - j1 + 4 * (i2 + 3 - j2) AS channel FROM range(3) a(i1), range(5) b(i2), range(2) c(j1), range(4) d(j2))
SELECT place, channel, count(*) OVER (PARTITION BY channel) AS count FROM g""")
def trajectory_indices(spark, d):
    xy = np.array([(i % 4, i // 4) for i in range(32)], float)
    _, places, channels, counts = K.trajectory(xy[:, 0], xy[:, 1])
    return spark.createDataFrame([(int(p), int(c), int(counts[c])) for p, c in zip(places, channels, strict=True)], "place long, channel long, count long")


@query("SELECT n, i, j, i + (n + 1) // 2 - 1 - j AS place FROM (SELECT unnest([9, 10, 32]) AS n) t, range(17) a(i), range(16) b(j) WHERE i < n // 2 + 1 AND j < (n + 1) // 2")
def toeplitz_indices(spark, d):
    rows = [(n, i, j, int(p)) for n in (9, 10, 32) for i, r in enumerate(K.toeplitz_indices(n)) for j, p in enumerate(r)]
    return spark.createDataFrame(rows, "n int, i long, j long, place long")


@query("""SELECT i AS position, CASE WHEN i <= 4 THEN i ELSE 8 - i END AS bin FROM range(8) t(i)""")
def expand_spectrum(spark, d):
    """Bins of a whole spectrum of eight samples in its half."""
    whole = K.expand(np.arange(5) * (1 + 0j), 8)
    return spark.createDataFrame([(i, int(x.real)) for i, x in enumerate(whole)], "position long, bin long")


@query(f"WITH {_LENGTHS} SELECT rec, k AS batch, round(k * (ns - 10) / 9.0::DOUBLE, 6) AS start FROM n, range(10) r(k)")
def even_batches(spark, d):
    lengths = views.table(spark, d, "events").groupBy(F.col("user_id").alias("rec")).agg(F.count(F.lit(1)).alias("ns"))
    return rounded(W.even_batches(lengths, 10, 10).select("rec", "batch", "start"), "start")


@query(f"""WITH {WAVES}, p AS (SELECT waveform_index, t AS pt FROM (SELECT *, row_number() OVER (PARTITION BY waveform_index ORDER BY abs(v) DESC, trace, t) AS k FROM wave) WHERE k = 1)
SELECT waveform_index, trace, count(*) FILTER (t < pt) AS n_pre, round(coalesce(sum(v) FILTER (t < pt), 0), 6) + 0.0 AS pre, round(sum(v) FILTER (t >= pt), 6) + 0.0 AS post
FROM wave JOIN p USING (waveform_index) GROUP BY 1, 2""")
def pre_post(spark, d):
    out = X.pre_post(_cells(spark, d), X.maximum(views.waveforms(spark, d)))
    out = out.groupBy("waveform_index", "trace").agg(F.count("pre").alias("n_pre"), F.coalesce(F.sum("pre"), F.lit(0.0)).alias("pre"), F.sum("post").alias("post"))
    return rounded(out, "pre", "post")


@query(f"WITH {WAVES} SELECT waveform_index, trace, round(sum(v), 6) + 0.0 AS total, count(*) AS n FROM wave GROUP BY 1, 2")
def one_channel(spark, d):
    out = X.one_channel(X.without_nan(views.waveforms(spark, d)))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select("waveform_index", F.col("trace").cast("long").alias("trace"), total.alias("total"), F.size("samples").cast("long").alias("n")), "total")


@query()
def model_waveforms(spark, d):
    """A modelled spike on 40 sites, beside each cluster's number."""

    def made(batches):
        spike = -np.exp(-(((np.arange(121) - 40) / 5.0) ** 2))
        sites = np.c_[np.tile([43, 11, 59, 27], 10), np.repeat(np.arange(20), 2) * 20.0 + 20]
        for batch in batches:
            for cluster in batch["cluster"]:
                w = K.model_waveform(spike, np.array([30.0, 200 + 10.0 * cluster]), sites, 30000)
                yield pd.DataFrame({"cluster": cluster, "site": np.arange(40), "lowest": np.round(w.min(1) * 1e6, 4)})

    return views.waveforms(spark, d).select("cluster").distinct().mapInPandas(made, "cluster bigint, site bigint, lowest double")


@query("""SELECT user_id AS rec, CASE WHEN count(*) > 1 THEN 17.14 ELSE 0 END::DOUBLE AS drift_ppm FROM events WHERE event_type = 'view' GROUP BY 1""")
def drift_of_clocks(spark, d):
    """Slope in parts per million between two event types' clocks of one user, the second an affine image of the first."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200
    e = views.table(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("rec"), t.alias("time"))
    both = e.withColumn("side", F.lit("a")).unionByName(e.select("rec", (F.col("time") * (1 + 17.14e-6) + 34.323).alias("time"), F.lit("b").alias("side")))
    return CL.clock_pairs(both, views.folder(spark, "clocks"), 60.0).groupBy("rec").agg(F.round(F.max("drift_ppm"), 2).alias("drift_ppm"))
