"""Streams with overlap, a stream into a file, densities and medians over blocks."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import kernels as K
from tracelake.operators import spectrum as P
from tracelake.operators import voltage as V
from tracelake.sources import files as FL
from tracelake.sources import recording as R
from tracelake.streaming import overlap as O
from tracelake.streaming import sink as T
from tracelake.streaming import stateful as S

SHAPE = "channel bigint, first_sample bigint, samples array<double>"


def feed(spark, at, parts):
    """A folder of files, one for each batch of the stream: lists of (channel, first_sample, samples)."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{at}/in")
        os.utime(max((os.path.join(f"{at}/in", f) for f in os.listdir(f"{at}/in")), key=os.path.getmtime), (k + 1e9, k + 1e9))
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def drained(spark, stream, at):
    out = S.drain(stream, at)
    got = {}
    for r in out.collect():
        assert (r.channel, r.first_sample) not in got
        got[r.channel, r.first_sample] = np.array(r.samples)
    return got


def cut(x, cuts, channel):
    return [(channel, a, x[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]


@pytest.mark.parametrize("cuts", [[0, 40, 80, 120, 160, 200, 230], [0, 7, 8, 150, 151, 230], [0, 230]])
def test_zero_phase_filter_of_a_stream(spark, tmp_path, cuts):
    """Equals the batch form at any cut, with rows that come early and rows that come again."""
    rng, sos = np.random.default_rng(1), K.butterworth(3, 0.1, "highpass")
    x = rng.normal(size=(2, 230))
    parts = [[r] for c in range(2) for r in cut(x[c], cuts, c)]
    order = [*rng.permutation(len(parts) - 1).tolist(), len(parts) - 1] if len(parts) > 3 else range(len(parts))
    batches = [parts[i] for i in order] + [parts[0]] + [[(0, 230, None), (1, 230, None)]]
    at = str(tmp_path)
    got = drained(spark, O.stream_overlapping(feed(spark, at, batches), lambda a: K.sosfiltfilt(sos, a), 40, 15, 15), at)
    blocks = spark.createDataFrame([(b, c, x[c, b * 40 : b * 40 + 40].tolist()) for b in range(6) for c in range(2)], "block bigint, channel bigint, samples array<double>")
    want = {(r.channel, r.block * 40): np.array(r.samples) for r in V.in_margins(blocks, lambda d: V.along_time(d, lambda a: K.sosfiltfilt(sos, a)), 15).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def test_windows_with_overlap_after_a_restart(spark, tmp_path):
    x = np.arange(100.0)
    at, made = str(tmp_path), {}
    for batches in ([[(5, 0, x[:33].tolist())]], [[(5, 33, x[33:61].tolist())], [(5, 61, x[61:].tolist())], [(5, 100, None)]]):
        stream = O.stream_overlapping(feed(spark, at, batches), lambda a: np.array([a.sum(), len(a)]), 20, 0, 10, whole=True)
        made = drained(spark, stream, at)  # a new query each time, from its checkpoint
    want = {(5, a): [x[a : a + 30].sum(), len(x[a : a + 30])] for a in (0, 20, 40, 60)} | {(5, 80): [x[80:].sum(), 20]}
    assert {k: v.tolist() for k, v in made.items()} == {k: v for k, v in want.items() if k in made} and set(want) - set(made) <= {(5, 80)}


def test_windows_in_a_session_that_names_no_state_store(spark, tmp_path):
    """The state has several variables, which Spark's own default doesn't hold."""
    name, x, at = "spark.sql.streaming.stateStore.providerClass", np.arange(50.0), str(tmp_path)
    plain = spark.newSession()
    plain.conf.set(name, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    stream = O.stream_overlapping(feed(plain, at, [[(5, 0, x.tolist())], [(5, 50, None)]]), lambda a: np.array([a.sum(), len(a)]), 20, 0, 10, whole=True)
    got = drained(plain, stream, at)
    assert {k: v.tolist() for k, v in got.items()} == {(5, a): [x[a : a + 30].sum(), len(x[a : a + 30])] for a in (0, 20)}
    assert "HDFSBacked" in plain.conf.get(name)


def test_a_recording_that_gets_no_more_rows_ends(spark, tmp_path):
    at = str(tmp_path)
    feed(spark, at, [[(1, 0, [1.0] * 25)]])
    stream = O.stream_overlapping(spark.readStream.schema(SHAPE).parquet(f"{at}/in"), lambda a: a * 2, 10, patience=500)
    query = stream.writeStream.outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", f"{at}/c").format("memory").queryName("ended").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("ended").count() == 3:
                break
        assert sorted((r.first_sample, r.samples) for r in spark.table("ended").collect()) == [(0, [2.0] * 10), (10, [2.0] * 10), (20, [2.0] * 5)]
    finally:
        query.stop()


NC = 3


def recorded(x, cuts):
    return [[(c, a, [float(v) for v in x[a:b, c]]) for c in range(NC)] for a, b in zip(cuts, cuts[1:], strict=False)]


def test_a_killed_stream_writes_every_sample_once(spark, tmp_path, monkeypatch):
    x, at = np.random.default_rng(2).integers(-999, 999, (100, NC)).astype(np.int16), str(tmp_path)
    file = f"{at}/out.bin"
    stream = feed(spark, at, recorded(x, [0, 30, 35, 70, 100]))
    real, calls = T.write_flat, []

    def killed(*args, **kwargs):
        calls.append(1)
        real(*args, **kwargs)
        if len(calls) == 2:
            raise RuntimeError("killed after the write, before the epoch is done")

    monkeypatch.setattr(T, "write_flat", killed)
    with pytest.raises(Exception, match="killed"):
        T.append_flat(stream, file, NC, at).trigger(availableNow=True).start().awaitTermination()
    assert os.path.getsize(file) == 35 * NC * 2
    with open(file, "ab") as f:  # and an append that died halfway
        FL.hold(file, 35 * NC * 2)
        f.write(b"\x01" * 50)
    monkeypatch.setattr(T, "write_flat", real)
    T.append_flat(stream, file, NC, at).trigger(availableNow=True).start().awaitTermination()
    assert open(file, "rb").read() == x.tobytes()
    feed(spark, at, recorded(x, [0, 100])[0:0])
    T.append_flat(stream, file, NC, at).trigger(availableNow=True).start().awaitTermination()  # nothing new
    assert open(file, "rb").read() == x.tobytes()


def test_a_stream_with_a_gap_is_refused(spark, tmp_path):
    x, at = np.zeros((60, NC), np.int16), str(tmp_path)
    stream = feed(spark, at, [recorded(x, [0, 20])[0], recorded(x, [0, 30, 60])[1]])
    with pytest.raises(Exception, match="begins at sample 30, the file ends at 20"):
        T.append_flat(stream, f"{at}/out.bin", NC, at).trigger(availableNow=True).start().awaitTermination()
    assert T.committed(f"{at}/out.bin", NC) == 20


def test_from_file_to_file(spark, tmp_path):
    """A growing recording followed by the source's stream, and written again."""
    spark.dataSource.register(R.RecordingSource)
    x, at = np.random.default_rng(4).integers(-99, 99, (90, NC)).astype(np.int16), str(tmp_path)
    for n in (50, 90):
        x[:n].tofile(f"{at}/in.bin")
        stream = spark.readStream.format("recording").option("channels", NC).option("block", 16).load(f"{at}/in.bin")
        T.append_flat(stream, f"{at}/out.bin", NC, at).trigger(availableNow=True).start().awaitTermination()
        assert open(f"{at}/out.bin", "rb").read() == x[:n].tobytes()


# --- spectra and medians ---------------------------------------------------------------
def blocked(spark, x, size):
    rows = [(a // size, c, x[c, a : a + size].tolist()) for c in range(len(x)) for a in range(0, x.shape[1], size)]
    return spark.createDataFrame(rows, "block bigint, channel bigint, samples array<double>").repartition(3)


@pytest.mark.parametrize("size, block, ns", [(64, 64, 500), (64, 100, 531), (31, 40, 200), (256, 300, 100), (16, 1000, 700), (2, 5, 40)])
def test_density_of_a_whole_recording(spark, size, block, ns):
    x = np.random.default_rng(7).normal(size=(2, ns)) + 3
    f, p = K.welch(x, 1000, size)
    got = {(r.channel, r.bin): (r.f, r.density) for r in P.density(blocked(spark, x, block), 1000, block, size).collect()}
    assert len(got) == p.size
    for (c, k), (freq, d) in got.items():
        assert abs(freq - f[k]) < 1e-9 and abs(d - p[c, k]) < 1e-12 + 1e-9 * p[c, k]


def test_log_density_and_limits(spark):
    x = np.random.default_rng(8).normal(size=(2, 900))
    edges, p = K.log_psd(x, 1000, 128)
    got = {(r.channel, r.i): (r.f, r.density) for r in P.log_density(P.density(blocked(spark, x, 200), 1000, 200, 128), 1000).collect()}
    assert len(got) == 2 * 127 and all(abs(got[c, i][0] - edges[i]) < 1e-9 and np.isclose(got[c, i][1], p[c, i]) for c in range(2) for i in range(127))
    with pytest.raises(ValueError, match="longer than a block"):
        P.density(blocked(spark, x, 50), 1000, 50, 128)
    assert P.density(blocked(spark, x, 200).limit(0), 1000, 200).count() == 0


@pytest.mark.parametrize("n", [1, 3, 11, 101])
def test_sliding_median(n):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=300), 1)  # ties
    half = n // 2
    wide = np.concatenate([np.repeat(x[:1], half), x, np.repeat(x[-1:], half)])
    assert (V.sliding_median(x, n) == [np.median(wide[i : i + n]) for i in range(300)]).all()
    assert len(V.sliding_median(x[:0], n)) == 0 and V.sliding_median(x[:1], n).tolist() == x[:1].tolist()


def test_sliding_median_with_gaps_and_width():
    x = np.r_[np.nan, 1.0, np.nan, 5.0, 2.0, np.inf, 3.0]
    assert np.array_equal(V.sliding_median(x, 3), [np.nan, np.nan, 5.0, 5.0, 5.0, 3.0, 3.0], equal_nan=True)
    with pytest.raises(ValueError):
        V.sliding_median(x, 4)
    x = np.random.default_rng(0).normal(size=60_000)
    took = []
    for n in (11, 1001):
        best = 9.0
        for _ in range(3):
            began = time.process_time()
            V.sliding_median(x, n)
            best = min(best, time.process_time() - began)
        took.append(best)
    assert took[1] < 2.5 * took[0] + 0.05


def test_median_filter_over_blocks(spark):
    x = np.random.default_rng(9).normal(size=(2, 230))
    got = {(r.channel, r.block): r.samples for r in V.median_filter(blocked(spark, x, 50), 41).collect()}
    for c in range(2):
        want = V.sliding_median(x[c], 41)
        assert np.allclose(np.concatenate([got[c, b] for b in range(5)]), want)
    rows = spark.createDataFrame([(b, i, float(x[b, i])) for b in range(2) for i in range(60)], "block bigint, channel bigint, v double")
    for r in V.running_median(rows, "v", 7).collect():
        assert r.trend == V.sliding_median(x[r.block, :60], 7)[r.channel]
    assert rows.select(F.max("v")).first()[0] is not None
