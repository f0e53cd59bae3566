"""Recordings whose last block lacks channels."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake import registry
from tracelake.functions import kernels as K
from tracelake.operators import voltage as V
from tracelake.sources import files as FL

AT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="no tables here")


@pytest.fixture(scope="module")
def part(tmp_path_factory):
    """Blocks of 100 channels, and a last one of 53 (three of its third shank), with DuckDB beside it."""
    con = pytest.importorskip("duckdb").connect()
    at = str(tmp_path_factory.mktemp("part"))
    con.execute(f"COPY (FROM '{AT}/embeddings.parquet' WHERE vec_id < 253) TO '{at}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS FROM '{at}/embeddings.parquet'")
    return at, con


def same_as_sql(spark, part, name):
    from test_queries import comparable

    at, con = part
    got, want = comparable(registry.QUERIES[name](spark, at).toPandas()), comparable(con.execute(registry.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        if want[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=2e-6), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_file_chunk_hashes(spark, part, tmp_path, monkeypatch):
    same_as_sql(spark, part, "file_chunk_hashes")
    monkeypatch.setattr(FL, "PLACE_RANGE", 4)  # blocks without some channels, over several ranges
    x = np.arange(60).reshape(10, 2, 3)
    rows = [(2 * b, c, x[b, :, c].astype(float).tolist()) for b in range(10) for c in range(3) if (b, c) not in ((1, 0), (4, 1), (4, 2))]
    places = FL.write_blocks(spark.createDataFrame(rows, "first_sample bigint, channel bigint, samples array<double>"), str(tmp_path / "a.bin"))
    want = [x[b][:, [c for c in range(3) if (2 * b, c) in {r[:2] for r in rows}]].ravel() for b in range(10)]
    assert np.fromfile(tmp_path / "a.bin", np.int16).tolist() == np.concatenate(want).tolist()
    at = np.r_[0, np.cumsum([2 * len(w) for w in want])].tolist()
    assert [tuple(r) for r in places.orderBy("first_sample").collect()] == [(2 * b, at[b], 2 * len(want[b])) for b in range(10)]


def test_flat_file(spark, part, tmp_path):
    same_as_sql(spark, part, "flat_file")
    rows = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 2, [3.0, 4.0])], "first_sample bigint, channel bigint, samples array<double>")
    with pytest.raises(Exception, match="has channels"):  # unless asked for
        FL.write_flat(rows, str(tmp_path / "a.bin"), 3)
    with pytest.raises(Exception, match="has channels"):
        FL.write_flat(rows.unionByName(rows), str(tmp_path / "a.bin"), 3, absent=9.0)
    FL.write_flat(rows, str(tmp_path / "a.bin"), 3, absent=9.0)
    assert np.fromfile(tmp_path / "a.bin", np.int16).tolist() == [1, 9, 3, 2, 9, 4]


def test_chunk_file(spark, part):
    same_as_sql(spark, part, "chunk_file")


def test_stream_recording(spark, part):
    same_as_sql(spark, part, "stream_recording")


def test_conversion_routes(spark, part):
    same_as_sql(spark, part, "conversion_routes")


def test_converted_shanks(spark, part):
    same_as_sql(spark, part, "converted_shanks")


def test_csd_filtered(spark, part):
    same_as_sql(spark, part, "csd_filtered")
    x = np.random.default_rng(1).normal(size=(9, 2))
    for kind, order in (("gaussian", (5, 1.0)), ("boxcar", 4), ("hamming", 3)):
        whole = K.density_filter(np.concatenate([x[:3], np.zeros((6, 2))]), kind, order)
        assert np.allclose(K.density_filter(x[:3], kind, order), whole[:3])
    assert K.source_density(x[:1], np.array([0.02]), "standard").tolist() == [[0, 0]]


def test_csd_spline(spark, part):
    """As many values as sites, those of the same spline at the sites' depths."""
    rows = registry.QUERIES["csd_spline"](spark, part[0]).where("block = 2 AND shank = 2").toPandas()
    x = np.stack([part[1].execute(f"SELECT embedding FROM embeddings WHERE vec_id = {250 + i}").fetchone()[0] for i in range(3)]).astype(float)
    z = np.arange(1, 4) * 0.02
    got = rows.pivot(index="channel", columns="sample", values="v").to_numpy()
    assert np.allclose(got, np.linalg.solve(K.spline_matrix(z, 0.5), x), atol=1e-5)
    for kind in ("delta", "step", "spline"):  # not defined for one depth
        assert np.isnan(K.source_density(x[:1], z[:1], kind)).all()


def test_destripe_in_margins(spark, part):
    """Channels that the last block lacks end before it, and the others' own samples don't depend on that."""
    from test_engine import near

    from tracelake.operators import geometry as G

    out = registry.QUERIES["destripe_in_margins"](spark, part[0])
    assert out.count() == 253 * 64 and out.where("v IS NULL OR isnan(v)").count() == 0
    x = np.random.default_rng(2).normal(size=(6, 1500)).cumsum(1)
    rows = [(b, c, 0, x[c, 500 * b : 500 * b + 500].tolist()) for b in range(3) for c in range(6) if (b, c) not in ((0, 1), (2, 4), (2, 5))]
    df = spark.createDataFrame(rows, "block bigint, channel bigint, shank bigint, samples array<double>")
    geometry = G.layout(spark, "1", channels=6).withColumn("sample_shift", F.lit(0.0))
    for labels in (None, spark.createDataFrame([(2, 1)], "channel long, label int")):
        for how in (False, True):
            made = {(r.block, r.channel): np.array(r.samples) for r in V.destripe(df, 2000, geometry, labels, how, 100, margin=128).collect()}
            assert set(made) == {r[:2] for r in rows} and all(len(v) == 500 for v in made.values())
    high = {c: K.sosfiltfilt(K.butterworth(3, 0.1, "highpass"), x[c, (c == 1) * 500 : 1500 - (c > 3) * 500]) for c in range(6)}
    made = {(r.block, r.channel): np.array(r.samples) for r in V.destripe(df, 2000, geometry, None, False, 100, margin=128).collect()}
    for b in range(3):
        there = [c for c in range(6) if (b, c) in made]
        own = np.stack([high[c][500 * b - (c == 1) * 500 :][:500] for c in there])
        assert near(np.stack([made[b, c] for c in there]), own - np.median(own, 0), 1e-2)


def test_saturation_over_blocks(spark, part):
    same_as_sql(spark, part, "saturation_over_blocks")


def test_mute_blocks(spark, part):
    same_as_sql(spark, part, "mute_blocks")


def test_destripe_job(spark, part):
    out = registry.QUERIES["destripe_job"](spark, part[0]).toPandas()
    assert sorted(zip(out.block, out.channel, strict=True)) == [(v // 100, v % 100) for v in range(253)] and out.rms.notna().all()


def test_median_over_blocks(spark, part):
    same_as_sql(spark, part, "median_over_blocks")
    x = np.random.default_rng(3).normal(size=30)
    for n in (3, 7, 41):
        half = n // 2
        for begins in (False, True):
            for ends in (False, True):
                wide = np.concatenate([np.repeat(x[:1], half * begins), x, np.repeat(x[-1:], half * ends)])
                want = [np.median(wide[max(0, i + half * begins - half) : i + half * begins + half + 1]) for i in range(30)]
                assert V.sliding_median(x, n, begins, ends).tolist() == want
