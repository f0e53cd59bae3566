"""Table functions with PARTITION BY, raw metrics of both bands, snippets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import sql as L
from tracelake.operators import geometry as G
from tracelake.operators import voltage as V
from tracelake.plans import jobs

NC, NS = 60, 700


@pytest.fixture(scope="module")
def probe(spark):
    adc, shift = G.converter(F.col("ind"), "1")
    return G.layout(spark, "1", channels=NC).withColumn("sample_shift", shift).cache()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    out = []
    for b in range(3):
        common = np.cumsum(rng.normal(size=NS)) * 2e-5
        x = common + rng.normal(size=(NC, NS)) * 1e-5 + 3e-5
        x[7] = rng.normal(size=NS) * 1e-8 + 1e-5  # dead
        x[20] += rng.normal(size=NS) * 4e-4  # noisy
        out += [(b, c, c // 30, x[c].tolist()) for c in range(NC)]
    return spark.createDataFrame(out, "block bigint, channel bigint, shank bigint, samples array<double>").repartition(4).cache()


def arrays(df, *keys):
    return {tuple(r[k] for k in keys): np.array(r.samples) for r in df.collect()}


def near(a, b):
    assert a.keys() == b.keys() and a
    for k in a:
        assert np.allclose(a[k], b[k], rtol=1e-9, atol=1e-15)


@pytest.mark.parametrize("k_filter", [True, False])
def test_destripe_called_from_sql(spark, rows, probe, k_filter):
    L.register(spark)
    labels = V.bad_channels(rows, 30000).where("block = 0").select("channel", "label")
    sites = probe.select(F.col("ind").alias("channel"), "x", "y", "sample_shift").join(labels, "channel")
    rows.join(sites, "channel").createOrReplaceTempView("rows_to_clean")
    got = spark.sql(f"SELECT * FROM signal_destripe(TABLE(rows_to_clean) PARTITION BY block, fs => 30000D, k_filter => {str(k_filter).lower()})")
    assert got.columns == spark.table("rows_to_clean").columns
    near(arrays(got, "block", "channel"), arrays(V.destripe(rows, 30000, probe, labels, k_filter), "block", "channel"))


def test_destripe_of_the_fewest_columns(spark, rows):
    L.register(spark)
    rows.select("channel", "block", "samples").where("shank = 0").createOrReplaceTempView("plain_rows")
    got = spark.sql("SELECT * FROM signal_destripe(TABLE(plain_rows) PARTITION BY block, fs => 30000D, corner => 500, k_filter => false)")
    want = V.across_channels(V.high_pass(rows.where("shank = 0"), 30000, 500), lambda x: x - np.median(x, 0))
    near(arrays(got, "block", "channel"), arrays(want, "block", "channel"))


def test_bad_channels_and_fronts_from_sql(spark, rows):
    L.register(spark)
    rows.createOrReplaceTempView("labelled_rows")
    got = spark.sql("SELECT * FROM signal_bad_channels(TABLE(labelled_rows) PARTITION BY block, fs => 30000D)")
    assert got.columns == ["block", "channel", "shank", "rms_raw", "xcor_hf", "xcor_lf", "psd_hf", "label"]
    want = {(r.block, r.channel): r for r in V.bad_channels(rows, 30000).collect()}
    for r in got.collect():
        w = want[r.block, r.channel]
        assert r.label == w.label and np.allclose([r.rms_raw, r.xcor_hf, r.xcor_lf, r.psd_hf], [w.rms_raw, w.xcor_hf, w.xcor_lf, w.psd_hf])
    assert {k[1] for k, r in want.items() if r.label == 1} == {7} and {k[1] for k, r in want.items() if r.label == 2} == {20}
    spark.createDataFrame([(c, i, v) for c in range(2) for i, v in enumerate([0.0, 0.0, 5.0, 5.0, 1.0, None, 9.0])], "channel int, sample int, v double").createOrReplaceTempView("steps")
    found = spark.sql("SELECT * FROM signal_fronts(TABLE(steps) PARTITION BY channel ORDER BY sample, step => 2)").collect()
    assert sorted((r.channel, r.sample, r.polarity) for r in found) == [(c, s, p) for c in range(2) for s, p in ((2, 5.0), (4, -4.0))]


def test_table_functions_say_what_is_missing(spark):
    L.register(spark)
    spark.range(3).createOrReplaceTempView("nothing_here")
    for text, why in (("signal_destripe(TABLE(nothing_here) PARTITION BY id, fs => 1D)", "no column channel, samples"), ("signal_fronts(5, 1)", "has to be a table")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {text}").collect()


def test_raw_table_of_both_bands(spark, rows, probe):
    """Twelve columns a band by snippet and channel, against the steps run one by one."""
    low = rows.where("block < 2").withColumn("samples", F.transform("samples", lambda x: x * 3))
    got = jobs.raw_table(rows, low, 30000, 2500, probe)
    assert len(got.columns) == 26
    table = {(r.snippet, r.channel): r for r in got.collect()}
    assert len(table) == 3 * NC and table[2, 0].lf_raw_rms is None and table[1, 0].lf_raw_rms is not None
    for band, df, fs, limit in (("ap", rows, 30000, 0.02), ("lf", low, 2500, 1.4)):
        features = {(r.block, r.channel): r for r in V.bad_channels(df, fs, psd_threshold=limit).collect()}
        butter = arrays(V.high_pass(df, fs) if band == "ap" else V.band_pass(df, fs, (2, 200)), "block", "channel")
        for block in (0, 1):
            one = df.where(F.col("block") == block)
            labels = spark.createDataFrame([(c, f.label) for (b, c), f in features.items() if b == block], "channel bigint, label bigint")
            clean = V.destripe(one, fs, probe, labels) if band == "ap" else V.destripe_lfp(one, fs, probe, labels)
            after = {r.channel: r for r in V.bad_channels(clean, fs, psd_threshold=limit).collect()}
            raw, made = arrays(one, "channel"), arrays(clean, "channel")
            for c in range(NC):
                r, f, a = table[block, c].asDict(), features[block, c], after[c]
                level = lambda x: np.sqrt((x * x).mean()) * 1e6
                want = [raw[c,].mean() * 1e6, level(raw[c,]), level(butter[block, c]), level(made[c,]), level(butter[block, c] - made[c,]), f.label, f.xcor_hf, f.xcor_lf, f.psd_hf, a.xcor_hf, a.xcor_lf, a.psd_hf]
                assert np.allclose([r[f"{band}_{k}"] for k in jobs._TABLE], want, rtol=1e-6, atol=1e-9), (band, block, c)


def test_snippets_cut_from_blocks(spark):
    x = np.arange(2 * 1000.0).reshape(2, 1000)
    cuts = [0, 130, 131, 400, 733, 1000]
    rows = [(a, c, 0, x[c, a:b].tolist()) for c in range(2) for a, b in zip(cuts, cuts[1:], strict=False)]
    df = spark.createDataFrame(rows, "first_sample bigint, channel bigint, shank bigint, samples array<double>")
    starts = spark.createDataFrame([(0, 0.0), (1, 1.25), (2, 8.9), (3, 20.0), (4, 1.3)], "snippet bigint, start double")
    got = arrays(jobs.snippets(df, starts, 100, 3), "block", "channel")
    assert {k[0] for k in got} == {0, 1, 2, 4}
    for s, a in ((0, 0), (1, 125), (2, 890), (4, 130)):
        for c in range(2):
            assert got[s, c].tolist() == x[c, a : a + 300].tolist()
