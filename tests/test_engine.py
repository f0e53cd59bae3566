"""Operators on recordings against analytic values and plain numpy."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import columns as C
from tracelake.functions import kernels as K
from tracelake.operators import clocks as CL
from tracelake.operators import events as E
from tracelake.operators import geometry as G
from tracelake.operators import voltage as V
from tracelake.operators import waveforms as X
from tracelake.operators import windows as W
from tracelake.plans import jobs
from tracelake.sources import metadata as M
from tracelake.sources import files as FL
from tracelake.sources import recording as R


def series(spark, values, channel=0):
    return spark.createDataFrame([(channel, i, float(v)) for i, v in enumerate(values)], "channel long, sample long, v double")


def test_headers(spark):
    h = G.trace_header(spark).orderBy("ind").toPandas()
    assert h["x"].tolist()[:4] == [43, 11, 59, 27] and h["y"].tolist()[:3] == [20, 20, 40]
    assert h["adc"].max() == 31 and np.isclose(h["sample_shift"].max(), 11 / 13)
    four = G.trace_header(spark, "2.4", 4).toPandas()
    assert sorted(four["shank"].unique()) == [0, 1, 2, 3] and (four.groupby("shank").size() == 96).all()
    assert four.groupby("shank")["row"].max().tolist() == [47] * 4
    with pytest.raises(ValueError):
        G.layout(spark, "9")


def test_windows(spark):
    n = spark.createDataFrame([(500,)], "ns long")
    w = W.windows(n, 100, 10).orderBy("iw").collect()
    assert [r["first"] for r in w] == [0, 90, 180, 270, 360, 450] and w[-1]["last"] == 500
    assert len(W.windows(n, 100, 50).collect()) == 9
    valid = [(r["valid_first"], r["valid_last"]) for r in w]
    assert valid[0][0] == 0 and valid[-1][1] == 500 and all(a[1] == b[0] for a, b in zip(valid, valid[1:], strict=False))


def test_fronts(spark):
    x = np.zeros(500)
    x[80:120] = 1
    x[200] = 1
    df = series(spark, x)
    assert sorted((r["sample"], r["polarity"]) for r in E.fronts(df).collect()) == [(80, 1), (120, -1), (200, 1), (201, -1)]
    assert sorted(r["sample"] for r in E.rises(df).collect()) == [80, 200]
    assert sorted(r["sample"] for r in E.rises(df, falling=True).collect()) == [120, 201]


def test_intervals(spark):
    flags = np.zeros(60, bool)
    flags[10:15] = flags[40:] = True
    df = spark.createDataFrame([(0, i, bool(f)) for i, f in enumerate(flags)], "block long, sample long, saturated boolean")
    assert sorted((r["start_sample"], r["stop_sample"]) for r in E.intervals(df).collect()) == [(10, 15), (40, 59)]


def test_mute_is_zero_in_saturation(spark):
    df = spark.createDataFrame([(0, i, 20 <= i < 40) for i in range(60)], "block long, sample long, saturated boolean")
    m = E.mute(df).orderBy("sample").toPandas()["mute"]
    assert (m[20:40] == 0).all() and (m[:16] == 1).all()


def test_venn_marginals(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(rng.integers(20)), k) for k, n in (("a", 300), ("b", 400), ("c", 500)) for s in rng.integers(0, 3000, n)]
    out = {r["mask"]: r["n"] for r in E.spike_venn(spark.createDataFrame(rows, "sample long, channel long, sorter string"), ["a", "b", "c"]).collect()}
    for i, n in enumerate((300, 400, 500)):
        assert sum(v for k, v in out.items() if k[i] == "1") == n


def test_clocks():
    rng = np.random.default_rng(1)
    a = np.cumsum(rng.uniform(1, 3, 50))
    b = a * (1 + 17.14e-6) + 34.323
    keep = np.delete(np.arange(50), [4, 20])
    i, j, slope, start = E.match_clocks(a, b[keep])
    assert i.tolist() == keep.tolist() and j.tolist() == list(range(48))
    assert np.isclose((slope - 1) * 1e6, 17.14, atol=1e-4) and np.isclose(start, 34.323, atol=1e-5)


def test_butterworth():
    sos = K.butterworth(3, 0.2, "highpass")
    w = np.exp(-1j * np.pi * np.array([1e-6, 0.2, 1 - 1e-9]))
    h = np.prod([(b0 + b1 * w + b2 * w * w) / (1 + a1 * w + a2 * w * w) for b0, b1, b2, _, a1, a2 in sos], axis=0)
    assert np.allclose(np.abs(h), [0, np.sqrt(0.5), 1], atol=1e-6)
    for kind, c in (("lowpass", 0.3), ("bandpass", (0.1, 0.4))):
        sos = K.butterworth(4, c, kind)
        w = np.exp(-1j * np.pi * np.atleast_1d(c))
        h = np.prod([(b0 + b1 * w + b2 * w * w) / (1 + a1 * w + a2 * w * w) for b0, b1, b2, _, a1, a2 in sos], axis=0)
        assert np.allclose(np.abs(h), np.sqrt(0.5))


def test_zero_phase_keeps_a_passed_sine():
    t = np.arange(2000) / 1000
    x = np.sin(2 * np.pi * 50 * t)
    y = K.sosfiltfilt(K.butterworth(3, 2 * 5 / 1000, "highpass"), x[None])[0]
    assert np.abs(y - x)[700:-700].max() < 1e-3
    assert np.abs(K.sosfiltfilt(K.butterworth(3, 2 * 5 / 1000, "highpass"), np.ones((1, 800)))).max() < 1e-8


def test_filter_state_continues():
    x = np.random.default_rng(0).normal(size=(2, 300))
    sos = K.butterworth(3, 0.1)
    whole = K.sosfilt(sos, x)[0]
    a, s = K.sosfilt(sos, x[:, :117])
    b, _ = K.sosfilt(sos, x[:, 117:], s)
    assert np.allclose(np.concatenate([a, b], 1), whole)


def test_shift_and_delay():
    x = np.exp(-(((np.arange(100) - 20) / 4) ** 2))[None]
    assert np.allclose(K.shift(x, 7)[0], np.roll(x[0], 7))
    assert np.isclose(K.shift_by_correlation(K.shift(x, 2.3)[0], x[0])[1], 2.3, atol=0.01)
    assert np.allclose(K.fit_delay(K.shift(x, 1.5), 1.0, 0.01, 0.05) - K.fit_delay(x, 1.0, 0.01, 0.05), 1.5, atol=1e-3)


def test_convolve():
    rng = np.random.default_rng(2)
    for n, m in ((64, 5), (65, 8), (40, 13)):
        x, w = rng.normal(size=n), rng.normal(size=m)
        assert np.allclose(K.convolve(x, w)[:-1], np.convolve(x, w))
        assert np.allclose(K.convolve(x, w, "same"), np.convolve(x, w, "same"))


def test_dft():
    x = np.random.default_rng(4).normal(size=(3, 50))
    assert np.allclose(K.dft(x), np.fft.rfft(x))


def test_parabola(spark):
    rows = [([0.0, 1.0, 2.0, 1.0, 0.0],), ([0.0, 1.0, 2.0, 2.5, 0.0],), ([5.0, 1.0, 0.0],), ([float("nan"), 1.0, 3.0, 1.0],)]
    out = spark.createDataFrame(rows, "x array<double>").select(X.parabolic_maximum(F.col("x")).alias("m")).collect()
    assert (out[0].m.i, out[0].m.v) == (2, 2) and out[2].m.i == 0 and out[3].m.i == 2
    assert 2 < out[1].m.i < 3 and out[1].m.v > 2.5


def test_fk_separates_velocities():
    si, dx, v1, v2 = 0.002, 5.0, 2000.0, 1000.0
    t, x = np.arange(1000) * si, np.arange(200) * dx
    wave = lambda v: np.stack([np.exp(-(((t - 0.4 - d / v) / 0.01) ** 2)) * np.cos(2 * np.pi * 40 * (t - 0.4 - d / v)) for d in x])
    fast, slow = wave(v1), wave(v2)
    kept = K.fk(fast + slow, si, dx, (1200, 1500), pad=0)
    inner = slice(40, -40)
    assert np.sqrt(np.mean((kept - fast)[inner] ** 2) / np.mean(fast[inner] ** 2)) < 0.2


def test_cadzow_recovers_a_plane_wave():
    rng = np.random.default_rng(0)
    y = np.arange(32) * 20.0
    t = np.arange(500) / 250
    clean = np.sin(2 * np.pi * 5 * t[None] + 0.01 * y[:, None])
    out = K.cadzow(clean + rng.normal(size=clean.shape) * 0.5, np.zeros(32), y, 250, 2, size=32, overlap=16)
    assert np.std(out - clean) < 0.75 * 0.5


def test_savgol():
    x = np.sort(np.random.default_rng(0).uniform(0, 10, 60))
    y = 1 + 2 * x - 0.3 * x**2
    assert np.allclose(K.savgol(x, y, 11, 2), y)
    with pytest.raises(ValueError):
        K.savgol(x, y, 10, 2)


def test_radon_round_trip():
    off, slopes = np.arange(12) * 10.0, np.linspace(-1e-3, 1e-3, 15)
    r = np.zeros((15, 200))
    r[9, 80:100] = np.hanning(20)
    d = K.radon(r, off, 0.002, slopes)
    assert np.abs(K.radon(K.inverse_radon(d, off, 0.002, slopes, damping=1e-6), off, 0.002, slopes) - d).max() < 0.05


def test_source_density_inverts():
    z = np.arange(1, 17) * 1e-4
    csd = np.sin(np.arange(16) / 3)[:, None] * np.ones((1, 3))
    for method, made in (("delta", K.delta_matrix), ("step", K.step_matrix)):
        assert np.allclose(K.source_density(made(z, 5e-4) @ csd, z, method), csd)
    assert np.allclose(K._spline_basis(z, z), np.eye(16))


def test_decimate_keeps_low_sines():
    t = np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 10 * t)[None]
    y = K.decimate(x, 5)[0]
    assert np.abs(y - x[0, ::5])[60:-60].max() < 1e-3


def test_common_reference_and_labels(spark):
    rng = np.random.default_rng(0)
    common = rng.normal(size=3000)
    x = common + 0.05 * rng.normal(size=(24, 3000))
    x[5] = 0.001 * rng.normal(size=3000)
    x[11] = common * 5
    df = spark.createDataFrame([(0, c, 0, r.tolist()) for c, r in enumerate(x)], "block long, channel long, shank long, samples array<double>")
    out = {r["channel"]: r["label"] for r in V.bad_channels(df, 30000, psd_threshold=1e12).collect()}
    assert out[5] == 1 and out[11] == 2 and sum(v == 0 for v in out.values()) >= 20
    left = V.common_reference(V.to_long(df)).where("channel = 0").agg(F.stddev("v")).first()[0]
    assert left < 0.1


def test_interpolation_weights(spark):
    geometry = G.layout(spark, channels=20)
    g = geometry.orderBy("ind").toPandas()
    labels = np.zeros(20, int)
    labels[7] = 1
    w = K.interpolation_weights(g["x"].to_numpy(), g["y"].to_numpy(), labels)
    v = np.arange(20.0)
    df = spark.createDataFrame([(0, c, 0, float(v[c])) for c in range(20)], "block long, channel long, sample long, v double")
    lab = spark.createDataFrame([(c, int(labels[c])) for c in range(20)], "channel long, label int")
    got = V.interpolate_bad(df, geometry, lab).where("channel = 7").first()["v"]
    assert np.isclose(got, (w @ v)[0])


def test_features_of_a_known_shape(spark):
    n = 60
    x = np.zeros((2, n))
    x[1, 20], x[1, 19], x[1, 21], x[1, 30], x[1, 12] = -10, -4, -4, 3, 1
    df = spark.createDataFrame([(0, x.tolist())], "waveform_index long, traces array<array<double>>")
    r = X.features(df, length=n).first()
    assert (r.peak_trace_idx, r.peak_time_idx, r.peak_val, r.trough_time_idx, r.trough_val, r.tip_time_idx) == (1, 20, -10, 30, 3, 12)
    assert (r.half_peak_pre_time_idx, r.half_peak_post_time_idx) == (19, 21) and r.recovery_time_idx == 35
    with pytest.raises(ValueError):
        X.features(df, length=4)


def test_extraction_gives_channel_numbers(spark):
    samples = spark.range(200 * 6).select(F.pmod("id", F.lit(6)).alias("channel"), F.floor(F.col("id") / 6).alias("sample"), F.pmod("id", F.lit(6)).cast("double").alias("v"))
    spikes = spark.createDataFrame([(0, 60, 2), (1, 100, 5)], "spike long, sample long, channel long")
    edges = spark.createDataFrame([(2, 0, 1), (2, 1, 2), (5, 0, 4), (5, 1, 6)], "channel long, slot long, neighbour long")
    out = {(r.spike, r.slot): r.samples for r in X.extract(spikes, X.to_blocks(samples, 64), edges, 4, 10, 64, None).collect()}
    assert out[0, 0] == [1.0] * 10 and out[1, 0] == [4.0] * 10 and out[1, 1] == [None] * 10


def test_metadata(spark, tmp_path):
    (tmp_path / "a.meta").write_text("typeThis=imec\nimDatPrb_type=0\nimSampRate=30000.5\nnSavedChans=5\nsnsApLfSy=4,0,1\nimAiRangeMax=0.6\nfileTimeSecs=2\n~imroTbl=(0,2)(0 0 0 500 250)(1 0 0 250 125)\n~snsShankMap=(1,2,2)(0:0:0:1)(0:1:0:0)\n")
    one = M.read(spark, str(tmp_path))
    m = F.col("meta")
    r = one.select(M.version(m).alias("v"), M.samples(m).alias("ns"), M.sync_channels(m).alias("s"), M.max_int(m).alias("i")).first()
    assert (r.v, r.ns, r.s, r.i) == ("3B1", 60001, [4], 512)
    volts = M.volts_per_bit(one).orderBy("channel").collect()
    assert np.isclose(volts[0].ap, 0.6 / 512 / 500) and np.isclose(volts[1].lf, 0.6 / 512 / 125) and volts[4].ap == 1 and volts[2].ap is None
    assert [(x.shank, x.a, x.b, x.flag) for x in M.sites(one).orderBy("place").collect()] == [(0, 0, 0, 1), (0, 1, 0, 0)]
    M.write(one, str(tmp_path / "out"))
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "out")).count() == 9
    assert M.lines(one).count() == 9


def test_recording_source(spark, tmp_path):
    spark.dataSource.register(R.RecordingSource)
    data = np.arange(1000 * 6, dtype=np.int16).reshape(1000, 6)
    data.tofile(tmp_path / "r.bin")
    df = spark.read.format("recording").option("channels", 6).option("block", 300).option("scale", 0.5).load(str(tmp_path / "r.bin"))
    rows = df.orderBy("block", "channel").collect()
    assert len(rows) == 4 * 6 and rows[0].samples[:2] == [0.0, 3.0] and len(rows[-1].samples) == 100
    np.save(tmp_path / "r.npy", data)
    assert spark.read.format("recording").load(str(tmp_path / "r.npy")).count() == 6
    bounds, offsets, blob = [0, 600, 1000], [0], b""
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = np.diff(data[a:b], axis=0, prepend=0).astype(np.int16)
        part[0] = data[a]
        blob += zlib.compress(part.tobytes(order="F"))
        offsets.append(len(blob))
    (tmp_path / "r.cbin").write_bytes(blob)
    (tmp_path / "r.ch").write_text(json.dumps({"chunk_bounds": bounds, "chunk_offsets": offsets, "chunk_order": "F", "do_time_diff": True, "do_spatial_diff": False, "dtype": "int16", "n_channels": 6}))
    packed = spark.read.format("recording").load(str(tmp_path / "r.cbin")).orderBy("block", "channel").collect()
    assert packed[1].samples == data[:600, 1].astype(float).tolist()
    stream = spark.readStream.format("recording").option("channels", 6).load(str(tmp_path / "r.bin"))
    q = stream.writeStream.format("memory").queryName("rec").trigger(once=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert spark.table("rec").count() == 6


def test_ranges(spark):
    ids = spark.createDataFrame([(x,) for x in (0, 1, 2, 5, 7, 8, 12)], "channel long")
    text = G.ranges_text(ids).first()[0]
    assert text == "0:2,5:5,7:8,12"
    assert sorted(r.channel for r in G.ranges_expanded(spark.createDataFrame([(text,)], "subset string")).collect()) == [0, 1, 2, 5, 7, 8, 12]


def test_splice_weights_sum_to_one(spark):
    w = W.windows(spark.createDataFrame([(500,)], "ns long"), 100, 20).withColumn("sample", F.explode(F.sequence("first", F.col("last") - 1)))
    total = w.groupBy("sample").agg(F.sum(W.splice_weight(F.col("sample"), F.col("first"), F.col("last"), F.col("ns"), 20)).alias("t")).toPandas()["t"]
    assert np.allclose(total, 1)


def test_bits(spark):
    r = spark.createDataFrame([(0b1000000000000101,)], "w int").select(C.bits(F.col("w")).alias("b")).first().b
    assert r == [1, 0, 1] + [0] * 12 + [1]


def test_queries_and_sql():
    from tracelake import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 90


# --- blocks of one recording ---------------------------------------------------------------
def recording(spark, blocks=8, size=256, channels=4, seed=0):
    """A drifting recording whole and in blocks: the matrix, and rows block, channel, shank, samples."""
    rng = np.random.default_rng(seed)
    n = blocks * size
    t = np.arange(n)
    x = np.cumsum(rng.normal(size=(channels, n)), 1) * 0.05 + np.sin(t / 7.0) + np.arange(channels)[:, None]
    rows = [(b, c, 0, x[c, b * size : (b + 1) * size].tolist()) for b in range(blocks) for c in range(channels)]
    return x, spark.createDataFrame(rows, "block long, channel long, shank long, samples array<double>")


def whole(df, channels=4):
    rows = sorted((r.block, r.channel, r.samples) for r in df.select("block", "channel", "samples").collect())
    return np.stack([np.concatenate([s for b, c, s in rows if c == k]) for k in range(channels)])


def near(got, want, tolerance):
    return np.abs(got - want).max() <= tolerance * np.abs(want).max()


def test_filters_in_margins_equal_the_whole(spark):
    x, df = recording(spark)
    sos = K.butterworth(3, 0.1, "highpass")
    want = K.sosfiltfilt(sos, x)
    assert near(whole(V.high_pass(df, 2000, 100, margin=128)), want, 1e-3)
    assert not near(whole(V.high_pass(df, 2000, 100)), want, 1e-2)
    assert near(whole(V.low_band(df, 4, 0.2, margin=128)), K.sosfiltfilt(K.butterworth(3, 0.2, "lowpass"), x)[:, ::4], 1e-3)
    band = K.sosfiltfilt(K.butterworth(3, np.array([0.1, 0.4]), "bandpass"), x)
    assert near(whole(V.band_pass(df, 2000, (100, 400), margin=200)), band, 1e-3)
    assert V.high_pass(df, 2000, 100, margin=128).columns == df.columns
    late = df.withColumn("sample_shift", F.col("channel") / 13)
    assert near(whole(V.rephase(late, margin=64))[:, 64:-64], K.shift(x, np.arange(4) / 13)[:, 64:-64], 1e-2)


def test_destripe_in_margins_equals_the_whole(spark):
    x, df = recording(spark, channels=6)
    geometry = G.layout(spark, "1", channels=6).withColumn("sample_shift", F.col("ind") / 13)
    labels = spark.createDataFrame([(2, 1)], "channel long, label int")
    one = spark.createDataFrame([(0, c, 0, x[c].tolist()) for c in range(6)], df.schema)
    for how in (False, True):
        a, b = whole(V.destripe(df, 2000, geometry, labels, how, 100, margin=128), 6), whole(V.destripe(one, 2000, geometry, labels, how, 100), 6)
        assert near(a[:, 300:-300], b[:, 300:-300], 2e-2), how
    plain = K.shift(K.sosfiltfilt(K.butterworth(3, 0.1, "highpass"), x), np.arange(6) / 13)
    g = geometry.orderBy("ind").toPandas()
    plain[2] = (K.interpolation_weights(g.x.to_numpy(), g.y.to_numpy(), np.array([0, 0, 1, 0, 0, 0])) @ plain)[0]
    assert near(whole(V.destripe(one, 2000, geometry, labels, False, 100), 6), plain - np.median(plain, 0), 1e-9)


def test_destripe_lfp_undoes_delays_of_version_one_alone(spark):
    x, df = recording(spark, blocks=1)
    geometry = G.layout(spark, "1", channels=4).withColumn("sample_shift", F.col("ind") / 13)
    band = K.sosfiltfilt(K.butterworth(3, 2 * np.array([0.5, 300]) / 2500, "bandpass"), x)
    late = K.shift(band, np.arange(4) / 13)
    assert near(whole(V.destripe_lfp(df, 2500, geometry)), late - np.median(late, 0), 1e-9)
    assert near(whole(V.destripe_lfp(df, 2500, geometry, version="2.4")), band - np.median(band, 0), 1e-9)


def test_resample_in_margins_equals_the_whole(spark):
    x, df = recording(spark, size=512)
    out = V.resample_lfp(df, 1000, 4, margin=512)
    high = K.sosfiltfilt(K.butterworth(3, 4 / 1000, "highpass"), x)
    want = K.decimate(high - np.median(high, 0), 4)
    got = whole(out)
    assert got.shape == want.shape and near(got[:, 150:-150], want[:, 150:-150], 5e-2)
    back = whole(out.withColumn("samples", F.zip_with("samples", "reference", lambda a, b: a + b)))
    assert near(back[:, 150:-150], K.decimate(high, 4)[:, 150:-150], 5e-2)


def test_saturation_over_blocks(spark):
    x, df = recording(spark, blocks=6, size=50, channels=5)
    x[:] = 0
    x[:, 90:160], x[:, 200:203] = 2.0, 2.0
    df = spark.createDataFrame([(b, c, 0, x[c, b * 50 : (b + 1) * 50].tolist()) for b in range(6) for c in range(5)], df.schema)
    sat = E.saturation_blocks(df, 2.0, 1.0, v_per_sec=1e9)
    assert {(r.start_sample, r.stop_sample) for r in E.intervals_blocks(sat, 50).collect()} == {(90, 160), (200, 203)}
    gain = np.concatenate([r.mute for r in sorted(E.mute_blocks(sat).collect())])
    flag = np.zeros(300)
    flag[90:160] = flag[200:203] = 1
    w = np.sin(np.pi / 7 * (np.arange(7) + 0.5))
    assert np.allclose(gain, np.maximum(0, 1 - np.convolve(flag, w, "same")))
    fast = E.saturation_blocks(df, 9.0, 1.0, v_per_sec=1.0)
    assert {r.start_sample for r in E.intervals_blocks(fast, 50).collect()} == {89, 159, 199, 202}


def test_intervals_over_blocks_end_with_the_recording(spark):
    rows = [(0, [False, True]), (1, [True, True]), (2, [False, True])]
    sat = spark.createDataFrame(rows, "block long, saturated array<boolean>")
    assert [(r.start_sample, r.stop_sample) for r in E.intervals_blocks(sat, 2).orderBy("start_sample").collect()] == [(1, 4), (5, 5)]


def test_destripe_job_and_its_options(spark, tmp_path):
    x, df = recording(spark, blocks=4)
    geometry = G.layout(spark, "1", channels=4).withColumn("sample_shift", F.lit(0.0))
    out = jobs.destripe_recording(df, str(tmp_path / "a"), 2000, geometry, max_voltage=1e9, mute=False, k_filter=False, margin=64, whitening=2 * np.eye(4), padding=10)
    clean = whole(V.destripe(df, 2000, geometry, None, False, margin=64))
    got = whole(out["traces"])
    assert np.allclose(got[:, :-10], 2 * clean) and np.allclose(got[:, -10:], 2 * clean[:, -1:]) and out["rms"].count() == 16
    more = jobs.destripe_recording(df.withColumn("block", F.col("block") + 4), str(tmp_path / "a"), 2000, geometry, max_voltage=1e9, mute=False, k_filter=False, margin=64, append=True)
    assert more["traces"].count() == 32 and more["rms"].count() == 32


def test_raw_features_against_numpy(spark):
    x, df = recording(spark, blocks=2, size=600)
    geometry = G.layout(spark, "1", channels=4).withColumn("sample_shift", F.lit(0.0))
    got = {(r.block, r.channel): r for r in jobs.raw_features(df, 30000, geometry).collect()}
    high = K.sosfiltfilt(K.butterworth(3, 0.02, "highpass"), x[:, 600:])
    clean = K.kfilt(high, 3000, epsilon=1e-8)
    for c in range(4):
        r = got[1, c]
        assert np.isclose(r.dc_offset, x[c, 600:].mean() * 1e6) and np.isclose(r.butter, np.sqrt((high[c] ** 2).mean()) * 1e6)
        assert np.isclose(r.destripe, np.sqrt((clean[c] ** 2).mean()) * 1e6) and np.isclose(r.striping, np.sqrt(((high - clean)[c] ** 2).mean()) * 1e6)
    assert jobs.raw_features_over_snippets(df, 30000, geometry).count() == 4


def test_shanks_split_and_checked(spark, tmp_path):
    x, df = recording(spark, blocks=3, channels=5)
    rows = df.drop("shank")
    geometry = spark.createDataFrame([(i, i // 2) for i in range(4)], "ind long, shank long")
    meta = M.parse(spark.createDataFrame([("a", t) for t in ("typeThis=imec", "imDatPrb_type=24", "imSampRate=30000", "nSavedChans=5", "snsApLfSy=4,0,1")], "path string, value string"))
    made = jobs.convert_shanks(rows, str(tmp_path / "s"), geometry, meta, q=4, margin=64)
    assert jobs.check_split(rows, made["ap"]).first().asDict() == {"missing": 0, "extra": 0, "differing": 0, "same": True}
    spoiled = made["ap"].where("NOT (block = 1 AND channel = 2)").withColumn("samples", F.when((F.col("block") == 0) & (F.col("channel") == 1), F.reverse("samples")).otherwise(F.col("samples")))
    told = jobs.check_split(rows, spoiled).first()
    assert (told.missing, told.extra, told.differing, told.same) == (1, 0, 1, False)
    low = made["lf"].where("channel < 4")
    assert near(whole(low), K.sosfiltfilt(K.butterworth(3, 0.2, "lowpass"), x[:4])[:, ::4], 1e-3)
    sync = [r.samples for r in made["lf"].where("channel = 4 AND to_shank = 1").orderBy("block").collect()]
    assert np.allclose(np.concatenate(sync), x[4, ::4])
    assert {(r.shank, r.band, r.meta["snsApLfSy"], r.meta["nSavedChans"], r.meta["imSampRate"]) for r in made["meta"].collect()} == {(s, b, c, "3", f) for s in (0, 1) for b, c, f in (("ap", "2,0,1", "30000"), ("lf", "0,2,1", "2500.0"))}


def test_clocks_far_apart_and_with_gaps(spark):
    rng = np.random.default_rng(3)
    a = np.cumsum(rng.uniform(0.5, 4, 300))
    b = a * (1 + 17.14e-6) + 3434.323
    keep_a, keep_b = rng.random(300) > 0.1, rng.random(300) > 0.1
    i, j, slope, start = E.match_clocks(a[keep_a], b[keep_b])
    ia, ib = np.flatnonzero(keep_a)[i], np.flatnonzero(keep_b)[j]
    assert (ia == ib).all() and len(ia) == (keep_a & keep_b).sum() and np.isclose((slope - 1) * 1e6, 17.14) and np.isclose(start, 3434.323)
    # two events within a bin: each goes to its own
    i, j, _, _ = E.match_clocks(np.array([0.0, 5.0, 5.04, 9.0, 20.0]), np.array([0.0, 5.0, 5.04, 9.0, 20.0]) + 2)
    assert i.tolist() == j.tolist() == [0, 1, 2, 3, 4]
    rows = [(1, "a", float(t)) for t in a] + [(1, "b", float(t)) for t in b] + [(2, "a", 1.0), (2, "b", 1.0)]
    found = {r.rec: (r.lag, r.n) for r in CL.clock_lag(spark.createDataFrame(rows, "rec long, side string, time double")).collect()}
    assert abs(found[1][0] + 34343) <= 1 and found[2] == (0, 1)


def test_fk_parts_and_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(24, 128))
    group = np.arange(24) // 12
    both = K.fk(x, 0.002, 5, (200, 400), pad=4, collection=group)
    for c in (0, 1):
        assert np.allclose(both[group == c], K.fk(x[group == c], 0.002, 5, (200, 400), pad=4))
    assert np.allclose(K.fk(np.ones((16, 64)), 0.002, 5, (200, 400)), 0) and np.allclose(K.fk(np.ones((16, 64)), 0.002, 5, (200, 400), "lowpass"), 1)
    wave = np.tile(np.sin(np.arange(64) * 2 * np.pi / 8), (16, 1))
    assert np.allclose(K.fk(wave, 0.002, 5, (200, 400)), wave)


def test_kernels_against_plain_numpy():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 90))
    assert np.allclose(K.rotate(x, 360), x) and np.allclose(K.rotate(K.rotate(x, 40), -40)[:, 1:], x[:, 1:], atol=0.5)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(5) / 4)
    gain = np.stack([np.convolve(np.abs(r), w / w.sum(), "same") for r in x])
    assert np.allclose(K.agc(x, 4, 1, 1e-8)[0], x / np.maximum(gain, 1e-8))
    f, p = K.welch(x, 100.0, 32)
    parts = [r - r.mean() for r in (x[0, a : a + 32] for a in range(0, 90 - 31, 16))]
    h = np.hanning(33)[:32]
    want = np.mean([np.abs(np.fft.rfft(r * h)) ** 2 for r in parts], 0) / 100 / (h**2).sum()
    want[1:-1] *= 2
    assert np.allclose(p[0], want)
    edges, means = K.log_psd(x, 100.0, 32)
    assert len(edges) == 127 and means.shape == (6, 127)
    full = K.svd_denoise(x, 6)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(full, x) and np.allclose(K.svd_denoise(x, 2), u[:, :2] * s[:2] @ v[:2])
    y = K.kfilt(x, None, pad=3, order=3, corner=0.1)
    z = np.concatenate([x[:3][::-1], x, x[-3:][::-1]])
    assert np.allclose(y, K.sosfiltfilt(K.butterworth(3, 0.1, "highpass"), z.T).T[3:9])
    assert np.allclose(K.expand(K.reduce(np.fft.fft(x)), 90), np.fft.fft(x)) and np.allclose(K.expand(np.fft.rfft(x[:, :89]), 89), np.fft.fft(x[:, :89]))
    t = np.arange(200)
    a, b = np.exp(-(((t - 90) / 6.0) ** 2)), np.exp(-(((t - 93.3) / 6.0) ** 2))
    slope, start = K.phase_calibration(a, 30000)
    assert np.isclose(slope, 2 * np.pi / 30000, rtol=1e-6) and abs(start) < 1e-9 and np.isclose(K.line_inverse(K.line(0.3, slope, start), slope, start), 0.3)
    for moved, lag in (K.shift_by_correlation(a, b), K.shift_by_phase(a, b, 30000)):
        assert abs(lag + 3.3) < 0.05 and np.abs(moved - a).max() < 0.02
    kernel = np.ones(3) / 3
    assert np.allclose(K.density_filter(x, "boxcar", 3), np.stack([np.convolve(c, kernel, "same") for c in x.T], 1))
    low = K.low_band(np.tile(np.sin(2 * np.pi * np.arange(1200) / 400), (2, 1)), 12)
    assert np.allclose(low[:, 20:80], np.sin(2 * np.pi * np.arange(0, 1200, 12) / 400)[20:80], atol=1e-3)


def test_waveform_files_round_trip(spark, tmp_path):
    samples = spark.range(300 * 2).select(F.pmod("id", F.lit(2)).alias("channel"), F.floor(F.col("id") / 2).alias("sample"), (F.pmod("id", F.lit(2)) * 1000 + F.floor(F.col("id") / 2)).cast("double").alias("v"))
    spikes = X.with_places(spark.createDataFrame([(k, 20 * k, k % 2, k % 3) for k in range(15)], "spike long, sample long, channel long, cluster long"))
    edges = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 1)], "channel long, slot long, neighbour long")
    at = str(tmp_path / "w")
    made = jobs.write_waveforms(spikes, X.to_blocks(samples, 64), edges, at, trough_offset=4, length=10, size=64)
    for r in made["traces"].collect():
        want = [r.neighbour * 1000.0 + 20 * r.spike - 4 + i if 0 <= 20 * r.spike - 4 + i < 300 else None for i in range(10)]
        assert all((w is None and np.isnan(g)) or g == w for g, w in zip(r.samples, want, strict=True))
    only = jobs.load_waveforms(spark, at, spark.createDataFrame([(1,)], "cluster long"), spark.createDataFrame([(0,), (2,)], "index_within_clusters long"))
    assert {(r.spike, r.slot) for r in only.collect()} == {(s, k) for s in (1, 7) for k in (0, 1)}
    assert jobs.waveform_properties(spark, at).first().asDict() == {"n_clusters": 3, "n_spikes": 15, "most_spikes": 5, "n_traces": 2, "n_samples": 10}


def test_places_over_many_clusters(spark, monkeypatch):
    monkeypatch.setattr(X, "RANGE", 3)
    rows = [(k, k * 7 % 50, k % 11) for k in range(60)]
    got = {r.spike: (r.index_within_clusters, r.waveform_index) for r in X.with_places(spark.createDataFrame(rows, "spike long, sample long, cluster long")).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    assert {s: i for i, (s, _, _) in enumerate(order)} == {s: w for s, (_, w) in got.items()}


def test_metadata_of_each_shank_and_geometry(spark):
    lines = ["typeThis=imec", "imDatPrb_type=24", "NP2.4_shank=1", "nSavedChans=3", "snsApLfSy=2,0,1", "~snsShankMap=(4,2,10)(0:0:0:1)(1:1:0:1)(1:0:0:1)(0:1:1:1)"]
    one = M.parse(spark.createDataFrame([("a", x) for x in lines], "path string, value string"))
    got = [(r.ind, r.shank, r.row, r.col, r.x, r.y, r.position) for r in M.geometry(one).orderBy("ind").collect()]
    assert got == [(0, 1, 0.0, 1.0, 59.0, 20.0, 0), (1, 1, 0.0, 0.0, 27.0, 20.0, 1)]


def test_cadzow_options():
    rng = np.random.default_rng(5)
    t = np.arange(200)
    x, y = np.tile([0.0, 32.0], 16), np.repeat(np.arange(16), 2) * 20.0
    clean = np.stack([np.sin(2 * np.pi * (t / 40 - 0.002 * p)) for p in y])
    noisy = clean + 0.5 * rng.normal(size=clean.shape)
    error = lambda z: np.sqrt(((z - clean) ** 2).mean())
    base = K.cadzow(noisy, x, y, 250, 2, fmax=None, size=16, overlap=8)
    for how in ({"pad": 6}, {"overlap": 12}, {"outlier": 3.0}, {"niter": 3}):
        assert error(K.cadzow(noisy, x, y, 250, 2, fmax=None, **({"size": 16, "overlap": 8} | how))) < 0.85 * error(noisy), how
    assert error(base) < 0.85 * error(noisy)
    # far channels become the model's, then the rank is reduced once more
    z = np.fft.rfft(noisy)[:, :4]
    model = K.cadzow_window(z, x, y, 2, 4)
    far = np.abs(z - model)
    limit = np.median(far, 0) + 2 * np.median(np.abs(far - np.median(far, 0)), 0)
    assert (far > limit).any()
    assert np.allclose(K.cadzow_window(z, x, y, 2, 4, outlier=2.0), K.cadzow_window(np.where(far > limit, model, z), x, y, 2, 4))
    # frequencies above the limit stay, or go
    high = K.cadzow(noisy, x, y, 250, 2, fmax=20, size=16, overlap=8)
    assert np.allclose(np.fft.rfft(high)[:, 20:], np.fft.rfft(noisy)[:, 20:])
    assert np.allclose(np.fft.rfft(K.cadzow(noisy, x, y, 250, 2, fmax=20, size=16, overlap=8, keep=False))[:, 20:], 0, atol=1e-9)
    # one frequency by hand: the matrix of one window, its best approximation, means over its diagonals
    z = np.fft.rfft(noisy)[:, 3]
    shape, places, channels, counts = K.trajectory(x, y)
    m = np.zeros(int(np.prod(shape)), complex)
    m[places] = z[channels]
    u, s, v = np.linalg.svd(m.reshape(shape), full_matrices=False)
    low = (u[:, :2] * s[:2] @ v[:2]).ravel()[places]
    want = np.array([low[channels == c].mean() for c in range(32)])
    assert np.allclose(K.cadzow_window(np.fft.rfft(noisy), x, y, 2, 5)[:, 3], want)
    assert np.isfinite(K.safe_svd(np.array([[np.nan, 1], [2, 3]]))[1]).all()


def test_gaps_filled_beyond_the_ends():
    t = np.arange(60.0)
    for kind, y, tolerance in (("linear", 3 * t + 1, 1e-8), ("cubic", 3 * t + 1, 1e-8), ("cubic", np.sin(t / 9), 0.02)):
        x = y.copy()
        x[[0, 1, 20, 21, 59]] = np.nan
        assert np.abs(K.savgol_interpolated(x, 7, 3, kind) - y)[2:59].max() < tolerance
    x = 3 * t + 1
    x[[0, 1, 59]] = np.nan
    assert np.allclose(K.savgol_interpolated(x, 7, 3), 3 * t + 1)


def test_recording_with_its_metadata(spark, tmp_path):
    data = np.arange(500 * 4, dtype=np.int16).reshape(500, 4)
    data[:, 3] = np.arange(500) % 2 * 5
    data.tofile(tmp_path / "a.ap.bin")
    (tmp_path / "a.ap.meta").write_text("typeThis=imec\nimDatPrb_type=0\nimDatPrb_port=1\nimDatPrb_slot=2\nimAiRangeMax=0.6\nnSavedChans=4\nsnsApLfSy=3,0,1\n~imroTbl=(0,3)(0 0 0 500 250)(1 0 0 250 125)(2 0 0 100 50)\n~snsShankMap=(1,2,3)(0:0:0:1)(0:1:0:1)(0:0:1:1)\nfileSHA1=AB\n")
    df = R.read_recording(spark, str(tmp_path / "a.ap.bin"), block=128)
    rows = {(r.block, r.channel): r for r in df.collect()}
    assert len(rows) == 16 and np.allclose(rows[1, 1].samples, data[128:256, 1] * 0.6 / 512 / 250) and rows[1, 3].x is None
    assert [rows[0, c].position for c in range(3)] == [0, 1, 2] and [rows[0, c].x for c in range(3)] == [43.0, 11.0, 59.0]
    part = R.read_recording(spark, str(tmp_path / "a.ap.bin"), block=128, first=100, last=140, only="1:2").collect()
    assert {(r.block, r.channel, r.first_sample, len(r.samples)) for r in part} == {(0, 1, 100, 28), (0, 2, 100, 28), (1, 1, 128, 12), (1, 2, 128, 12)}
    cut = R.between(df, 120, 130).where("channel = 0").orderBy("block").collect()
    assert [(r.first_sample, len(r.samples)) for r in cut] == [(120, 8), (128, 2)]
    words = R.sync_words(df, 3)
    fronts = E.write_sync(E.sync_lines(words, spark.createDataFrame([(i, 0, 0, 5.0 if i > 50 else 0.0) for i in range(100)], "sample long, window long, channel long, v double")), 100.0, str(tmp_path / "sync"))
    assert {(r.channel, r.n) for r in fronts.groupBy("channel").count().withColumnRenamed("count", "n").collect()} == {(0, 499), (2, 499), (16, 1)}
    told = FL.same_as_told(spark, str(tmp_path / "*.ap.*"), M.read(spark, str(tmp_path / "a.ap.meta"))).first()
    assert told.same is False and told.told == "ab"
    files = R.with_system(spark.createDataFrame([("f", "imec0", "a", None, None), ("f", "", None, None, "n")], "folder string, label string, ap string, lf string, nidq string"))
    assert {r.system for r in files.collect()} == {"3B"}


def test_random_waveforms_and_user_aggregates(spark):
    a, b = (X.random_waveforms(spark.newSession(), 40, 4, noise=0.01, seed=3).orderBy("waveform_index").collect() for _ in range(2))
    assert [r.traces for r in a] == [r.traces for r in b] and {r.cluster for r in a} == {0, 1, 2, 3}
    peaks = {r.cluster: int(np.abs(np.array(r.traces)).max(1).argmax()) for r in a}
    assert all(int(np.abs(np.array(r.traces)).max(1).argmax()) == peaks[r.cluster] for r in a)
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 5.0), (0, 0, 3.0)], "label long, sample long, v double")
    assert V.stack(df, operator=lambda c: F.max(c) - F.min(c)).first().v == 4.0
    moved = X.shifted(X.random_waveforms(spark, 12, 2, seed=1), X.random_waveforms(spark, 12, 2, seed=1).select("cluster", F.posexplode("traces").alias("trace", "t")).select("cluster", "trace", F.posexplode("t").alias("sample", "v")))
    assert all(abs(r.lag) < 1e-6 for r in moved.collect())


def test_bad_channels_of_each_kind(spark):
    """A dead, a noisy and some outer channels among like ones, by fixed and adaptive thresholds."""
    rng = np.random.default_rng(11)
    n, fs = 4000, 30000
    common = K.sosfiltfilt(K.butterworth(3, [0.03, 0.3], "bandpass"), rng.normal(size=(1, n)))[0] * 2e-5
    x = np.tile(common, (60, 1)) + rng.normal(size=(60, n)) * 2e-6
    x[20] *= 0.05
    x[30] += rng.normal(size=n) * 2e-4
    x[48:] = rng.normal(size=(12, n)) * 2e-6
    df = spark.createDataFrame([(0, c, x[c].tolist()) for c in range(60)], "block long, channel long, samples array<double>")
    for threshold in (-0.75, "adaptive"):
        got = {r.channel: r.label for r in V.bad_channels(df, fs, outside_threshold=threshold).collect()}
        assert got[20] == 1 and got[30] == 2 and got[10] == 0 and got[59] == 3, threshold
    assert {c for c, label in got.items() if label == 3} <= set(range(40, 60))
