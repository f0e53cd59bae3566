"""Queries on voltage traces, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import views
from ..functions import kernels as K
from ..operators import geometry as G
from ..operators import voltage as V
from ..views import SIGNAL

R = 6
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *names):
    """The columns rounded, and minus zero as zero."""
    return df.withColumns({n: F.round(n, R) + F.lit(0.0) for n in names})



def recursion_sql(name: str, source: str, sos: np.ndarray, start: str | None = None) -> str:
    """CTE ``name`` (block, channel, t, y): a cascade of sections over ``source`` (block, channel, t from 0, v).

    ``start``: the state before the first sample is the steady one for its
    value (``steady``), or nothing.
    """
    k = len(sos)
    b, a = [[float(x) for x in r[:3]] for r in sos], [[float(x) for x in r[4:]] for r in sos]
    state, scale = [], 1.0
    for r in range(k):
        gain = sum(b[r]) / (1 + sum(a[r]))
        second = b[r][2] - a[r][1] * gain
        state += [scale * (b[r][1] - a[r][0] * gain + second), scale * second]
        scale *= gain
    begin = ", ".join(f"({x if start == 'steady' else 0.0!r})::DOUBLE * v AS s{i}" for i, x in enumerate(state))
    names = ", ".join(f"s{i}" for i in range(2 * k))
    steps, x = [], "v"
    told = ["t + 1 AS t"]
    out = f"{name}_0 AS (SELECT block, channel, -1 AS t, 0.0::DOUBLE AS y, {begin} FROM {source} WHERE t = 0)"
    inner = "SELECT p.block, p.channel, q.t, q.v, " + ", ".join(f"p.s{i}" for i in range(2 * k)) + f" FROM {name} p JOIN {source} q ON p.block = q.block AND p.channel = q.channel AND q.t = p.t + 1"
    for r in range(k):
        inner = f"SELECT *, {b[r][0]!r} * {x} + s{2 * r} AS y{r} FROM ({inner})"
        steps += [f"{b[r][1]!r} * {x} - {a[r][0]!r} * y{r} + s{2 * r + 1} AS n{2 * r}", f"{b[r][2]!r} * {x} - {a[r][1]!r} * y{r} AS n{2 * r + 1}"]
        x = f"y{r}"
    return f"""{out},
{name} AS (SELECT * FROM {name}_0 UNION ALL SELECT block, channel, t, {x}, {', '.join(s.split(' AS ')[0] for s in steps)} FROM ({inner}))"""


def zero_phase_sql(name: str, source: str, n: int, sos: np.ndarray) -> str:
    """CTE ``name`` (block, channel, sample, v): forward and backward over ``source`` (block, channel, sample, v), mirrored oddly at both ends."""
    taps = 2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
    edge = min(3 * taps, n - 1)
    size = n + 2 * edge
    return f"""{name}_e AS MATERIALIZED (SELECT a.block, a.channel, t.t, CASE WHEN t.t < {edge} THEN 2 * f.v - a.v WHEN t.t >= {n + edge} THEN 2 * l.v - a.v ELSE a.v END AS v
  FROM range({size}) t(t) JOIN {source} a ON a.sample = CASE WHEN t.t < {edge} THEN {edge} - t.t WHEN t.t >= {n + edge} THEN {2 * n + edge - 2} - t.t ELSE t.t - {edge} END
  JOIN {source} f ON f.block = a.block AND f.channel = a.channel AND f.sample = 0 JOIN {source} l ON l.block = a.block AND l.channel = a.channel AND l.sample = {n - 1}),
{recursion_sql(name + "_f", name + "_e", sos, "steady")},
{name}_r AS MATERIALIZED (SELECT block, channel, {size - 1} - t AS t, y AS v FROM {name}_f WHERE t >= 0),
{recursion_sql(name + "_b", name + "_r", sos, "steady")},
{name} AS MATERIALIZED (SELECT block, channel, {size - 1} - t - {edge} AS sample, y AS v FROM {name}_b WHERE t >= 0 AND {size - 1} - t BETWEEN {edge} AND {n + edge - 1})"""


def delay_sql(name: str, source: str, delay: str, n: int = 64) -> str:
    """CTE ``name``: ``source`` (block, channel, sample, v) delayed by ``delay`` samples, by its spectrum."""
    return f"""{name}_f AS (SELECT s.block, s.channel, k.k, sum(v * cos(2 * pi() * k.k * sample / {n})) AS re, -sum(v * sin(2 * pi() * k.k * sample / {n})) AS im FROM {source} s, range({n // 2 + 1}) k(k) GROUP BY 1, 2, 3),
{name}_g AS (SELECT *, 2 * pi() * k * ({delay}) / {n} AS a FROM {name}_f),
{name} AS MATERIALIZED (SELECT block, channel, t.t AS sample, sum(CASE WHEN k IN (0, {n // 2}) THEN 1 ELSE 2 END * ((re * cos(a) + im * sin(a)) * cos(2 * pi() * k * t.t / {n}) - CASE WHEN k IN (0, {n // 2}) THEN 0 ELSE im * cos(a) - re * sin(a) END * sin(2 * pi() * k * t.t / {n}))) / {n} AS v
  FROM {name}_g, range({n}) t(t) GROUP BY 1, 2, 3)"""


#: A trace's delay as a part of the sample, version 1.
SHIFT1 = "(channel % 24 // 2) / 13.0::DOUBLE"


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql


GEOM = """geom AS (
  SELECT i AS ind, (i // 2)::DOUBLE * 20 + 20 AS y, [2, 0, 3, 1][(i % 4 + 1)::INT]::DOUBLE * 16 + 11 AS x FROM range(100) t(i))"""


def _cells(df):
    """Array rows as one for each sample, rounded."""
    return rounded(V.to_long(df).withColumn("sample", F.col("sample").cast("long")), "v")


@query(f"""WITH {SIGNAL} SELECT block, channel, shank, label, sample, round(v - median(v) OVER (PARTITION BY block, shank, sample), 6) + 0.0 AS v FROM sig""")
def car_median(spark, d):
    return _cells(V.reference_blocks(views.signal(spark, d)))


@query(f"""WITH {SIGNAL} SELECT block, channel, shank, label, sample, round(v - avg(v) OVER (PARTITION BY block, shank, sample), 6) + 0.0 AS v FROM sig""")
def car_mean(spark, d):
    return _cells(V.reference_blocks(views.signal(spark, d), "mean"))


@query(f"""WITH {SIGNAL} SELECT block, channel, round(sqrt(avg(v * v)), 6) AS rms, round(avg(v), 6) + 0.0 AS dc_offset FROM sig GROUP BY 1, 2""")
def rms_channel(spark, d):
    df = views.signal_long(spark, d)
    return rounded(df.groupBy("block", "channel").agg(V.rms(F.col("v")).alias("rms"), F.avg("v").alias("dc_offset")), "rms", "dc_offset")


@query(f"""WITH {SIGNAL}, c AS (SELECT *, v - median(v) OVER (PARTITION BY block, shank, sample) AS c FROM sig)
SELECT block, channel, round(sqrt(avg(c * c)), 6) AS rms, min(sample) AS first_sample, max(sample) AS last_sample FROM c GROUP BY 1, 2""")
def block_rms_after_car(spark, d):
    energy, n = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x), F.size("samples")
    out = V.reference_blocks(views.signal(spark, d)).select("block", "channel", F.sqrt(energy / n).alias("rms"), F.lit(0).cast("long").alias("first_sample"), (n - 1).cast("long").alias("last_sample"))
    return rounded(out, "rms")


@query(f"""WITH {SIGNAL} SELECT label, sample, round(avg(v), 6) + 0.0 AS v, count(*) AS fold FROM sig GROUP BY 1, 2""")
def stack_mean(spark, d):
    return rounded(V.stack(views.signal_long(spark, d)), "v")


@query(f"""WITH {SIGNAL} SELECT label, sample, round(median(v), 6) + 0.0 AS v, count(*) AS fold FROM sig GROUP BY 1, 2""")
def stack_median(spark, d):
    return rounded(V.stack(views.signal_long(spark, d), operator="median"), "v")


@query(f"""WITH {SIGNAL}, m AS (SELECT *, v - avg(v) OVER (PARTITION BY block, channel) AS c FROM sig),
r AS (SELECT *, median(c) OVER (PARTITION BY block, sample) AS r0 FROM m),
q AS (SELECT *, r0 - avg(r0) OVER (PARTITION BY block, channel) AS r FROM r)
SELECT block, channel, round(sum(c * r) / sum(r * r), 6) + 0.0 AS xcor FROM q GROUP BY 1, 2""")
def xcor_median_reference(spark, d):
    return rounded(V.similarity_blocks(views.signal(spark, d)), "xcor")


_PAD = "[x[1], x[1], x[1], x[1], x[1]] || x || [x[-1], x[-1], x[-1], x[-1], x[-1]]"


@query(f"""WITH {SIGNAL}, e AS (SELECT block, channel, sum(v * v) AS e FROM sig GROUP BY 1, 2),
l AS (SELECT block, list(channel ORDER BY channel) AS c, list(e ORDER BY channel) AS x FROM e GROUP BY 1),
p AS (SELECT block, c, x, {_PAD} AS y FROM l),
u AS (SELECT block, c, x, y, unnest(range(1, len(x) + 1)) AS i FROM p)
SELECT block, c[i] AS channel, round(x[i] - list_sort(y[i:i + 10])[6], 6) + 0.0 AS detrended FROM u""")
def detrend_median11(spark, d):
    e = views.signal_long(spark, d).groupBy("block", "channel").agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    out = V.running_median(e, "e")
    return rounded(out.select("block", "channel", (F.col("e") - F.col("trend")).alias("detrended")), "detrended")


@query(f"""WITH {SIGNAL}, x AS (SELECT vec_id // 100 AS block, vec_id % 100 AS channel, (vec_id % 4)::BIGINT AS label FROM embeddings),
c AS (SELECT channel, CASE WHEN channel % 7 = 0 THEN label ELSE 0 END AS label, count(*) AS n FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, label) AS k FROM c)
SELECT channel, label FROM r WHERE k = 1""")
def label_mode(spark, d):
    e = views.table(spark, d, "embeddings")
    channel = F.pmod("vec_id", F.lit(100))
    label = F.when(channel % 7 == 0, F.pmod("vec_id", F.lit(4))).otherwise(F.lit(0).cast("long"))
    return V.label_mode(e.select(channel.alias("channel"), label.alias("label")))


@query(f"""WITH {SIGNAL.replace("sig AS (", "sig AS MATERIALIZED (")}, {GEOM},
p AS (SELECT a.ind AS target, g.ind AS channel, exp(-((sqrt((a.x - g.x) ** 2 + (a.y - g.y) ** 2) / 20.0::DOUBLE) ** 1.3)) AS w
  FROM geom a, geom g WHERE a.ind % 13 = 5 AND g.ind % 13 <> 5),
w AS MATERIALIZED (SELECT * FROM p WHERE w >= 0.005),
m AS MATERIALIZED (SELECT s.block, w.target, s.sample, sum(w.w * s.v) / sum(w.w) AS made FROM sig s JOIN w ON w.channel = s.channel GROUP BY 1, 2, 3)
SELECT s.block, s.channel, s.sample, round(CASE WHEN s.channel % 13 = 5 THEN coalesce(m.made, 0.0) ELSE s.v END, 6) + 0.0 AS v
FROM sig s LEFT JOIN m ON m.block = s.block AND m.target = s.channel AND m.sample = s.sample""")
def interpolate_bad(spark, d):
    geometry = G.layout(spark, "1", channels=100)
    labels = spark.range(100).select(F.col("id").alias("channel"), F.when(F.col("id") % 13 == 5, 1).otherwise(0).alias("label"))
    df = views.signal(spark, d).select("block", "channel", "shank", "samples")
    return _cells(V.interpolate_blocks(df, geometry, labels)).drop("shank")


@query(f"""WITH {SIGNAL}, p AS (SELECT *, channel // 2 AS row, channel % 2 AS col FROM sig),
k AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM p WINDOW w AS (PARTITION BY block, col, sample ORDER BY row)),
c AS (SELECT *, (a - 2 * v + b) / 4 / 3 AS c FROM k),
e AS (SELECT *, coalesce(c, lead(c) OVER w, lag(c) OVER w) AS csd FROM c WINDOW w AS (PARTITION BY block, col, sample ORDER BY row))
SELECT block, channel, sample, round(csd, 6) + 0.0 AS csd FROM e""")
def csd_diff2(spark, d):
    df = views.signal_long(spark, d).withColumn("row", F.floor(F.col("channel") / 2)).withColumn("col", F.pmod("channel", F.lit(2)))
    return rounded(V.source_density(df, 2.0), "csd").select("block", "channel", "sample", "csd")


@query(f"""WITH {SIGNAL}, p AS (SELECT *, channel // 2 AS row, channel % 2 AS col FROM sig),
k AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM p WINDOW w AS (PARTITION BY block, col, sample ORDER BY row)),
c AS (SELECT *, (b - v) / 2 / 3 AS c FROM k),
e AS (SELECT *, CASE WHEN a IS NULL THEN lead(c) OVER w ELSE coalesce(c, lag(c) OVER w) END AS csd FROM c WINDOW w AS (PARTITION BY block, col, sample ORDER BY row))
SELECT block, channel, sample, round(csd, 6) + 0.0 AS csd FROM e""")
def csd_diff1(spark, d):
    df = views.signal_long(spark, d).withColumn("row", F.floor(F.col("channel") / 2)).withColumn("col", F.pmod("channel", F.lit(2)))
    return rounded(V.source_density(df, 2.0, n=1), "csd").select("block", "channel", "sample", "csd")


@query("""SELECT i, j, round(0.1 / (2 * 0.3) * (sqrt((i * 0.1 - j * 0.1) ** 2 + 0.25 ** 2) - abs(i * 0.1 - j * 0.1)), 9) AS f
FROM range(1, 17) a(i), range(1, 17) b(j)""")
def delta_csd_matrix(spark, d):
    m = K.delta_matrix(np.arange(1, 17) * 0.1, 0.5)
    return spark.createDataFrame([(i + 1, j + 1, float(x)) for i, r in enumerate(m) for j, x in enumerate(r)], "i long, j long, f double").select("i", "j", F.round("f", 9).alias("f"))


@query(f"""WITH {SIGNAL} SELECT s.block, s.channel, k.k, round(sum(v * cos(2 * pi() * k.k * sample / 64)), 6) + 0.0 AS re,
round(-sum(v * sin(2 * pi() * k.k * sample / 64)), 6) + 0.0 AS im FROM sig s, range(33) k(k) GROUP BY 1, 2, 3""")
def dft(spark, d):
    # one pass over each batch of arrays; no row is repeated for a frequency
    def both(x):
        z = K.dft(x)
        return np.concatenate([z.real, z.imag], 1)

    made = V.along_time(views.signal(spark, d).select("block", "channel", "samples"), both)
    lines = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda k: F.struct(k.cast("long").alias("k"), F.get("samples", k).alias("re"), F.get("samples", k + 33).alias("im")))
    return rounded(made.select("block", "channel", F.inline(lines)), "re", "im")


@query(f"""WITH {SIGNAL}, f AS (SELECT block, channel, k.k, sum(v * cos(2 * pi() * k.k * sample / 64)) AS re, -sum(v * sin(2 * pi() * k.k * sample / 64)) AS im
  FROM sig, range(33) k(k) GROUP BY 1, 2, 3),
g AS (SELECT *, re * cos(2 * pi() * k * 0.3 / 64) + im * sin(2 * pi() * k * 0.3 / 64) AS r2, im * cos(2 * pi() * k * 0.3 / 64) - re * sin(2 * pi() * k * 0.3 / 64) AS i2 FROM f)
SELECT block, channel, t.t AS sample, round(sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (r2 * cos(2 * pi() * k * t.t / 64) - i2 * sin(2 * pi() * k * t.t / 64)) ) / 64, 6) + 0.0 AS v
FROM g, range(64) t(t) GROUP BY 1, 2, 3""")
def fshift(spark, d):
    df = views.signal(spark, d).select("block", "channel", "samples")
    return rounded(V.to_long(V.along_time(df, lambda x: K.shift(x, 0.3))).withColumn("sample", F.col("sample").cast("long")), "v")


def _filter_sql(gain: str) -> str:
    return f"""WITH {SIGNAL}, f AS (SELECT block, channel, k.k, sum(v * cos(2 * pi() * k.k * sample / 64)) AS re, -sum(v * sin(2 * pi() * k.k * sample / 64)) AS im
  FROM sig, range(33) k(k) GROUP BY 1, 2, 3),
c AS (SELECT *, k / 64.0::DOUBLE AS f FROM f), g AS (SELECT *, {gain} AS gain FROM c)
SELECT block, channel, t.t AS sample, round(sum(gain * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * t.t / 64) - im * sin(2 * pi() * k * t.t / 64))) / 64, 6) + 0.0 AS v
FROM g, range(64) t(t) GROUP BY 1, 2, 3"""


def _ramp(a: float, b: float) -> str:
    return f"(CASE WHEN f <= {a} THEN 0 WHEN f >= {b} THEN 1 ELSE (1 - cos((f - {a}) / ({b} - {a})::DOUBLE * pi())) / 2 END)"


def _filtered(spark, d, corners, kind):
    df = views.signal(spark, d).select("block", "channel", "samples")
    out = V.along_time(df, lambda x: K.frequency_filter(x, 1.0, corners, kind))
    return rounded(V.to_long(out).withColumn("sample", F.col("sample").cast("long")), "v")


@query(_filter_sql(_ramp(0.05, 0.15)))
def filter_hp(spark, d):
    return _filtered(spark, d, (0.05, 0.15), "hp")


@query(_filter_sql("1 - " + _ramp(0.1, 0.3)))
def filter_lp(spark, d):
    return _filtered(spark, d, (0.1, 0.3), "lp")


@query(_filter_sql(_ramp(0.05, 0.1) + " * (1 - " + _ramp(0.3, 0.4) + ")"))
def filter_bp(spark, d):
    return _filtered(spark, d, (0.05, 0.1, 0.3, 0.4), "bp")


@query(f"""WITH {SIGNAL}, s AS (SELECT a.block, a.channel, a.sample, sum(b.v * [0.25, 0.5, 0.25][(a.sample - b.sample + 2)::INT]) AS v
  FROM sig a JOIN sig b ON a.block = b.block AND a.channel = b.channel AND abs(a.sample - b.sample) <= 1 GROUP BY 1, 2, 3)
SELECT block, channel, sample, round(v, 6) + 0.0 AS v FROM s""")
def convolve_same(spark, d):
    df = views.signal(spark, d).select("block", "channel", "samples")
    out = V.along_time(df, lambda x: K.convolve(x, np.array([0.25, 0.5, 0.25]), "same"))
    return rounded(V.to_long(out).withColumn("sample", F.col("sample").cast("long")), "v")


_HANN5 = "([0.0, 0.25, 0.5, 0.25, 0.0]::DOUBLE[])"


@query(f"""WITH {SIGNAL}, s AS (SELECT a.block, a.channel, a.sample, any_value(a.v) AS v, sum(abs(b.v) * {_HANN5}[(a.sample - b.sample + 3)::INT]) AS g
  FROM sig a JOIN sig b ON a.block = b.block AND a.channel = b.channel AND abs(a.sample - b.sample) <= 2 GROUP BY 1, 2, 3)
SELECT block, channel, sample, round(v / greatest(g, 1e-8::DOUBLE), 5) + 0.0 AS v FROM s""")
def agc(spark, d):
    df = views.signal(spark, d).select("block", "channel", "samples")
    out = V.to_long(V.along_time(df, lambda x: K.agc(x, 4, 1, 1e-8)[0])).withColumn("sample", F.col("sample").cast("long"))
    return out.withColumn("v", F.round("v", 5) + F.lit(0.0))


@query(f"""WITH {SIGNAL} SELECT block, channel, sample // 4 AS sample, v FROM sig WHERE sample % 4 = 0""")
def decimate_select(spark, d):
    return views.signal_long(spark, d).where("sample % 4 = 0").select("block", "channel", F.floor(F.col("sample") / 4).alias("sample"), "v")


@query(f"""WITH {SIGNAL} SELECT shank, block, channel, sum(v)::DOUBLE AS total FROM (SELECT * FROM sig) GROUP BY 1, 2, 3""".replace("sum(v)::DOUBLE AS total", "round(sum(v), 6) + 0.0 AS total"))
def shank_split(spark, d):
    geometry = spark.range(100).select(F.col("id").alias("ind"), F.floor(F.col("id") / 25).alias("shank"))
    out = V.split_shanks(views.signal(spark, d).select("block", "channel", "samples"), geometry)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return rounded(out.select(F.col("to_shank").alias("shank"), "block", "channel", total.alias("total")), "total")


@query(f"""WITH {SIGNAL} SELECT block, channel, sample, v FROM sig""")
def shank_rebuild(spark, d):
    geometry = spark.range(99).select(F.col("id").alias("ind"), F.floor(F.col("id") / 25).alias("shank"))
    split = V.split_shanks(views.signal(spark, d).select("block", "channel", "samples"), geometry)
    return V.to_long(V.join_shanks(split)).select("block", "channel", F.col("sample").cast("long").alias("sample"), "v")


# --- dense linear algebra; without SQL where the tests hold it against numpy ---------------------
def _probe_rows(spark, d):
    return views.signal(spark, d).select("block", "channel", "shank", "samples")


def _probe_geometry(spark):
    adc, shift = G.converter(F.col("ind"), "1")
    return G.layout(spark, "1", channels=100).withColumn("sample_shift", shift)


@query(
    recursive(f"""{SIGNAL}, {zero_phase_sql("hp", "sig", 64, K.butterworth(3, 0.02, "highpass"))}, {delay_sql("ph", "hp", SHIFT1)}
SELECT block, channel, channel // 25 AS shank, sample, round(v - median(v) OVER (PARTITION BY block, channel // 25, sample), 6) + 0.0 AS v FROM ph""")
)
def destripe_car(spark, d):
    out = V.to_long(V.destripe(_probe_rows(spark, d), 30000, _probe_geometry(spark), k_filter=False))
    return rounded(out.withColumn("sample", F.col("sample").cast("long")), "v")


@query()
def destripe_kfilt(spark, d):
    labels = spark.range(100).select(F.col("id").alias("channel"), F.when(F.col("id") % 13 == 5, 1).when(F.col("id") > 95, 3).otherwise(0).alias("label"))
    return rounded(V.to_long(V.destripe(_probe_rows(spark, d), 30000, _probe_geometry(spark), labels)), "v")


@query(
    recursive(f"""{SIGNAL}, {zero_phase_sql("bp", "sig", 64, K.butterworth(3, 2 * np.array([0.5, 300]) / 2500, "bandpass"))}, {delay_sql("ph", "bp", SHIFT1)}
SELECT block, channel, channel // 25 AS shank, sample, round(v - median(v) OVER (PARTITION BY block, channel // 25, sample), 6) + 0.0 AS v FROM ph""")
)
def destripe_lfp(spark, d):
    out = V.to_long(V.destripe_lfp(_probe_rows(spark, d), 2500, _probe_geometry(spark)))
    return rounded(out.withColumn("sample", F.col("sample").cast("long")), "v")


@query()
def destripe_in_margins(spark, d):
    """Destriping of the blocks as parts of one recording, each with samples of its neighbours."""
    return rounded(V.to_long(V.destripe(_probe_rows(spark, d), 30000, _probe_geometry(spark), k_filter=False, margin=32)), "v")


def _similarity_sql(name: str, source: str) -> str:
    return f"""{name}_m AS (SELECT *, v - avg(v) OVER (PARTITION BY block, channel) AS c FROM {source}),
{name}_r AS (SELECT *, median(c) OVER (PARTITION BY block, sample) AS r0 FROM {name}_m),
{name}_q AS (SELECT *, r0 - avg(r0) OVER (PARTITION BY block, channel) AS r FROM {name}_r),
{name}_x AS (SELECT block, channel, sum(c * r) / sum(r * r) AS x FROM {name}_q GROUP BY 1, 2),
{name}_l AS (SELECT block, list(channel ORDER BY channel) AS c, list(x ORDER BY channel) AS x FROM {name}_x GROUP BY 1),
{name}_p AS (SELECT block, c, x, {_PAD} AS y FROM {name}_l),
{name}_u AS (SELECT block, c, x, y, unnest(range(1, len(x) + 1)) AS i FROM {name}_p),
{name} AS (SELECT block, c[i] AS channel, x[i] AS x, list_sort(y[i:i + 10])[6] AS trend FROM {name}_u)"""


_LABELS = f"""{SIGNAL}, {zero_phase_sql("hp", "sig", 64, K.butterworth(3, 0.02, "highpass"))},
{_similarity_sql("raw", "sig")}, {_similarity_sql("low", "hp")},
rm AS (SELECT block, channel, sqrt(avg(v * v)) AS rms FROM sig GROUP BY 1, 2),
pc AS (SELECT block, channel, sample, 1e6 * (v - avg(v) OVER (PARTITION BY block, channel)) * (1 - cos(2 * pi() * sample / 64)) / 2 AS v FROM sig),
pf AS (SELECT block, channel, k.k, (sum(v * cos(2 * pi() * k.k * sample / 64)) ** 2 + sum(v * sin(2 * pi() * k.k * sample / 64)) ** 2) * CASE WHEN k.k = 32 THEN 1 ELSE 2 END / 24 / 30000 AS p FROM pc, range(26, 33) k(k) GROUP BY 1, 2, 3),
ps AS (SELECT block, channel, avg(p) AS psd FROM pf GROUP BY 1, 2),
ft AS (SELECT block, channel, rms AS rms_raw, raw.x - raw.trend AS xcor_hf, low.trend - 1 AS xcor_lf, psd AS psd_hf FROM rm JOIN raw USING (block, channel) JOIN low USING (block, channel) JOIN ps USING (block, channel)),
lb AS (SELECT *, min((xcor_lf < -0.75)::INT) OVER (PARTITION BY block ORDER BY channel DESC) AS out FROM ft),
labelled AS (SELECT *, CASE WHEN xcor_hf > 1 OR psd_hf > 0.02 THEN 2 WHEN xcor_hf < -0.5 THEN 1 WHEN out = 1 THEN 3 ELSE 0 END::BIGINT AS label FROM lb)"""


@query(recursive(f"{_LABELS} SELECT block, channel, label, round(rms_raw, 6) AS rms_raw, round(xcor_hf, 6) + 0.0 AS xcor_hf, round(xcor_lf, 6) + 0.0 AS xcor_lf, round(psd_hf, 6) AS psd_hf FROM labelled"))
def bad_channel_labels(spark, d):
    return rounded(V.bad_channels(_probe_rows(spark, d), 30000), "rms_raw", "xcor_hf", "xcor_lf", "psd_hf")


@query(
    recursive(f"""{SIGNAL}, {delay_sql("ph", "sig", SHIFT1)}, {zero_phase_sql("hp", "ph", 64, K.butterworth(3, 4 / 2500, "highpass"))},
cr AS MATERIALIZED (SELECT block, channel, sample, v - median(v) OVER (PARTITION BY block, sample) AS v FROM hp),
tp AS (SELECT j, CASE WHEN j = 128 THEN 1 ELSE sin(pi() * (j - 128) / 4) / (pi() * (j - 128) / 4) END * (0.54 - 0.46 * cos(2 * pi() * j / 256)) AS w FROM range(257) t(j)),
tw AS (SELECT o.o, least(greatest(4 * o.o + 128 - j, 0), 63) AS at, sum(w) / (SELECT sum(w) FROM tp) AS w FROM tp, range(16) o(o) GROUP BY 1, 2)
SELECT block, channel, channel // 25 AS shank, o::BIGINT AS sample, round(sum(w * v), 6) + 0.0 AS v FROM tw JOIN cr ON cr.sample = tw.at GROUP BY 1, 2, 3, 4""")
)
def resample_lfp(spark, d):
    out = V.resample_lfp(_probe_rows(spark, d), 2500, 4, _probe_geometry(spark)).drop("reference")
    return rounded(V.to_long(out).withColumn("sample", F.col("sample").cast("long")), "v")


@query()
def svd_denoise(spark, d):
    return rounded(V.to_long(V.svd_denoise(_probe_rows(spark, d))), "v")


@query()
def cadzow(spark, d):
    return rounded(V.to_long(V.cadzow(_probe_rows(spark, d), _probe_geometry(spark))), "v")


@query()
def kfilt(spark, d):
    return rounded(V.to_long(V.across_channels(_probe_rows(spark, d), lambda x: K.kfilt(x, 300), ("block", "shank"))), "v")


@query()
def fk(spark, d):
    return rounded(V.to_long(V.across_channels(_probe_rows(spark, d), lambda x: K.fk(x, 0.002, 5, (200, 400), pad=10))), "v")


@query(f"""WITH {SIGNAL}, c AS (SELECT block, channel, sample, (v - avg(v) OVER (PARTITION BY block, channel)) * (1 - cos(2 * pi() * sample / 64)) / 2 AS v FROM sig),
f AS (SELECT block, channel, k.k, sum(v * cos(2 * pi() * k.k * sample / 64)) ** 2 + sum(v * sin(2 * pi() * k.k * sample / 64)) ** 2 AS p FROM c, range(33) k(k) GROUP BY 1, 2, 3),
g AS (SELECT block, channel, k, p * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 24 AS p FROM f),
e AS (SELECT i, CASE WHEN i = 127 THEN 31 ELSE floor(2 ** (i * log2(15000) / 127) / 15000 * 32) END::BIGINT AS k FROM range(128) t(i))
SELECT g.block, g.channel, a.i AS sample, round(avg(g.p), 6) + 0.0 AS v FROM e a JOIN e b ON b.i = a.i + 1 JOIN g ON g.k BETWEEN a.k AND b.k GROUP BY 1, 2, 3""")
def psd_log(spark, d):
    """Power densities times the sampling rate."""
    out = V.along_time(_probe_rows(spark, d).select("block", "channel", "samples"), lambda x: K.log_psd(x, 30000, 64)[1] * 30000)
    return rounded(V.to_long(out).withColumn("sample", F.col("sample").cast("long")), "v")


_SPECTRUM = "f AS (SELECT block, channel, k.k, sum(v * cos(2 * pi() * k.k * sample / 64)) AS re, -sum(v * sin(2 * pi() * k.k * sample / 64)) AS im FROM sig, range(33) k(k) GROUP BY 1, 2, 3)"


@query(f"""WITH {SIGNAL}, {_SPECTRUM} SELECT block, channel, t.t AS sample, round(sum(-im * cos(2 * pi() * k * t.t / 64) - re * sin(2 * pi() * k * t.t / 64)) / 32, 6) + 0.0 AS v
FROM f, range(64) t(t) WHERE k BETWEEN 1 AND 31 GROUP BY 1, 2, 3""")
def dephase(spark, d):
    out = V.to_long(V.along_time(_probe_rows(spark, d), lambda x: K.rotate(x, 90)).select("block", "channel", "samples"))
    return rounded(out.withColumn("sample", F.col("sample").cast("long")), "v")


@query(f"""WITH {SIGNAL}, {_SPECTRUM}, p AS (SELECT block, channel, k / 64.0::DOUBLE AS f, k, atan2(im, re) AS a FROM f WHERE k BETWEEN 4 AND 19),
d AS (SELECT *, a - lag(a) OVER (PARTITION BY block, channel ORDER BY k) AS d FROM p),
u AS (SELECT *, a - 2 * pi() * sum(coalesce(round(d / (2 * pi())), 0)) OVER (PARTITION BY block, channel ORDER BY k) AS u FROM d)
SELECT block, channel, round(-regr_slope(u, f) / (2 * pi()), 6) + 0.0 AS v FROM u GROUP BY 1, 2""")
def fit_phase(spark, d):
    out = V.along_time(_probe_rows(spark, d), lambda x: K.fit_delay(x, 1.0, 0.05, 0.3)[:, None])
    return rounded(out.select("block", "channel", F.col("samples")[0].alias("v")), "v")


@query(f"""WITH {SIGNAL}, a AS (SELECT s.block, o.o, s.sample, -2 * pi() * ((s.channel // 2) * (o.o // 2) / 4.0::DOUBLE + (s.channel % 2) * (o.o % 2) / 2.0::DOUBLE) AS a, v FROM sig s, range(8) o(o)),
m AS (SELECT block, o, sample, sqrt(sum(v * cos(a)) ** 2 + sum(v * sin(a)) ** 2) AS v FROM a GROUP BY 1, 2, 3)
SELECT s.block, s.channel, s.sample, round(m.v, 6) + 0.0 AS v FROM sig s JOIN m ON m.block = s.block AND m.o = s.channel % 8 AND m.sample = s.sample""")
def dft2(spark, d):
    def one(x):
        r, c = np.arange(len(x)) // 2, np.arange(len(x)) % 2
        return np.abs(K.dft2(x, r, c, 4, 2)).reshape(8, -1)[np.arange(len(x)) % 8]

    out = V.to_long(V.across_channels(_probe_rows(spark, d).select("block", "channel", "samples"), one))
    return rounded(out.withColumn("sample", F.col("sample").cast("long")), "v")


@query()
def tau_p(spark, d):
    def one(x):
        offset, slopes = np.arange(len(x)) * 20e-6, np.linspace(-1, 1, len(x)) * 1e-2
        return K.radon(K.inverse_radon(x, offset, 1 / 30000, slopes), offset, 1 / 30000, slopes)

    return rounded(V.to_long(V.across_channels(_probe_rows(spark, d), one, ("block", "shank"))), "v")


@query(f"""WITH {SIGNAL}, w AS (SELECT t, j, 1 / 11.0::DOUBLE + t * j / 110.0::DOUBLE + (t * t - 10) * (j * j - 10) / 858.0::DOUBLE + (t ** 3 - 17.8 * t) * (j ** 3 - 17.8 * j) / 6177.6::DOUBLE AS w FROM range(-5, 6) a(t), range(-5, 6) b(j)),
c AS (SELECT block, channel, sample, least(greatest(sample, 5), 58) AS c FROM sig)
SELECT c.block, c.channel, c.sample, round(sum(w.w * s.v), 6) + 0.0 AS v FROM c JOIN w ON w.t = c.sample - c.c JOIN sig s ON s.block = c.block AND s.channel = c.channel AND s.sample = c.c + w.j GROUP BY 1, 2, 3""")
def savgol(spark, d):
    out = V.along_time(_probe_rows(spark, d).select("block", "channel", "samples"), lambda x: np.stack([K.savgol(np.arange(x.shape[1], dtype=float), r, 11, 3) for r in x]))
    return rounded(V.to_long(out).withColumn("sample", F.col("sample").cast("long")), "v")


@query(f"""WITH {SIGNAL}, p AS MATERIALIZED (SELECT s.block, s.channel, t.t, s.v FROM range(90) t(t) JOIN sig s ON s.sample = least(greatest(t.t - 13, 0), 63)),
f AS (SELECT block, channel, k.k, sum(v * cos(2 * pi() * k.k * t / 90)) AS re, -sum(v * sin(2 * pi() * k.k * t / 90)) AS im FROM p, range(18) k(k) GROUP BY 1, 2, 3),
g AS (SELECT *, CASE WHEN k <= 9 THEN 1 ELSE 1 - (1 - cos((k / 90.0::DOUBLE - 0.1) / 0.1 * pi())) / 2 END AS gain FROM f)
SELECT block, channel, t.t AS sample, round(sum(gain * CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * k * (t.t + 13) / 90) - im * sin(2 * pi() * k * (t.t + 13) / 90))) / 90, 6) + 0.0 AS v FROM g, range(64) t(t) GROUP BY 1, 2, 3""")
def smooth_lp(spark, d):
    out = V.along_time(_probe_rows(spark, d).select("block", "channel", "samples"), lambda x: np.stack([K.smooth_lowpass(r, (0.2, 0.4)) for r in x]))
    return rounded(V.to_long(out).withColumn("sample", F.col("sample").cast("long")), "v")


#: Depths of a shank's sites, in millimetres.
DEPTHS = np.arange(1, 26) * 0.02


def _csd(method, **more):
    def run(spark, d):
        made = V.across_channels(_probe_rows(spark, d), lambda x: K.source_density(x, DEPTHS[: len(x)], method, 0.5, **more), ("block", "shank"))
        return rounded(V.to_long(made).withColumn("sample", F.col("sample").cast("long")), "v")

    return run


QUERIES["csd_standard"], QUERIES["csd_delta"], QUERIES["csd_step"], QUERIES["csd_spline"] = _csd("standard"), _csd("delta"), _csd("step"), _csd("spline", steps=None)
_STANDARD = f"""{SIGNAL}, d AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM sig WINDOW w AS (PARTITION BY block, shank, sample ORDER BY channel)),
c AS (SELECT block, channel, shank, sample, -0.3 * (coalesce(a, v) - 2 * v + coalesce(b, v)) / 0.02 ** 2 AS v FROM d)"""
SQL["csd_standard"] = f"WITH {_STANDARD} SELECT block, channel, shank, sample, round(v, 6) + 0.0 AS v FROM c"
SQL["csd_filtered"] = f"""WITH {_STANDARD}, w AS (SELECT k, exp(-k * k / 2.0::DOUBLE) AS w FROM range(-2, 3) t(k)), n AS (SELECT sum(w) AS n FROM w)
SELECT a.block, a.channel, a.shank, a.sample, round(sum(b.v * w.w) / any_value(n.n), 6) + 0.0 AS v FROM c a, w, n, c b WHERE b.block = a.block AND b.shank = a.shank AND b.sample = a.sample AND b.channel = a.channel + w.k GROUP BY 1, 2, 3, 4"""


@query(
    recursive(f"""{SIGNAL}, tp AS MATERIALIZED (SELECT block, channel, sample, v * CASE WHEN sample <= 0 OR sample >= 63 THEN 0 WHEN sample < 8 THEN (1 - cos(sample / 8.0::DOUBLE * pi())) / 2 WHEN sample > 55 THEN (1 + cos((sample - 55) / 8.0::DOUBLE * pi())) / 2 ELSE 1 END AS v FROM sig),
{zero_phase_sql("lo", "tp", 64, K.butterworth(3, 0.2, "lowpass"))}
SELECT block, channel, (sample // 4)::BIGINT AS sample, round(v, 6) + 0.0 AS v FROM lo WHERE sample % 4 = 0""")
)
def lfp_band(spark, d):
    """The low band of each trace: tapered, low-passed, every fourth sample."""
    out = V.along_time(_probe_rows(spark, d).select("block", "channel", "samples"), lambda x: K.low_band(x, 4, 8))
    return rounded(V.to_long(out).withColumn("sample", F.col("sample").cast("long")), "v")


@query(
    recursive(f"""{_LABELS}, n AS (SELECT channel, label, count(*) AS n FROM labelled GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, label) AS k FROM n)
SELECT channel, label FROM r WHERE k = 1""")
)
def bad_channels_mode(spark, d):
    """The commonest label of each channel over blocks."""
    return V.label_mode(V.bad_channels(_probe_rows(spark, d), 30000))


@query()
def savgol_gaps(spark, d):
    """Smoothing of traces in which every ninth sample is missing."""

    def one(x):
        x = x.copy()
        x[:, ::9] = np.nan
        return np.stack([K.savgol_interpolated(r, 11, 3) for r in x])

    return rounded(V.to_long(V.along_time(_probe_rows(spark, d), one)), "v")


@query()
def csd_filtered(spark, d):
    made = lambda x: K.density_filter(K.source_density(x, DEPTHS[: len(x)], "standard", 0.5), "gaussian", (5, 1.0))
    out = V.to_long(V.across_channels(_probe_rows(spark, d), made, ("block", "shank")))
    return rounded(out.withColumn("sample", F.col("sample").cast("long")), "v")
