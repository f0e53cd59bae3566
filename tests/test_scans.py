"""Joined runs, samples of groups: against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import kernels as K
from tracelake.operators import events as E
from tracelake.operators import samples as S
from tracelake.operators import waveforms as X


def runs_of(flags):
    """start and stop (first false after; an open run ends at the last sample)."""
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, min(i, len(flags) - 1)))
            start = None
    return out


@pytest.mark.parametrize("size, fan", [(1, 2), (3, 2), (7, 3), (50, 256), (400, 256)])
@pytest.mark.parametrize("share", [0.5, 0.97, 1.0, 0.0])
def test_intervals_at_any_block_size(spark, size, fan, share):
    rng = np.random.default_rng(int(size * fan + share * 100))
    flags = (rng.random(371) < share).tolist()
    rows = [(i // size, flags[i : i + size]) for i in range(0, len(flags), size)]
    got = E.intervals_blocks(spark.createDataFrame(rows, "block bigint, saturated array<boolean>").repartition(3), size, fan=fan)
    assert sorted((r.start_sample, r.stop_sample) for r in got.collect()) == runs_of(flags)


def test_no_window_over_all_runs(spark):
    sat = spark.createDataFrame([(0, [True])], "block bigint, saturated array<boolean>")
    plan = E.intervals_blocks(sat, 1)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan


def chosen(rows, k, seed):
    by = {}
    for spike, cluster in rows:
        by.setdefault(cluster, []).append((hashlib.md5(f"{spike}:{seed}".encode()).hexdigest(), spike))
    return sorted((s, c) for c, x in by.items() for _, s in sorted(x)[:k])


@pytest.mark.parametrize("k, held", [(3, 40), (1, 7), (50, 50_000), (1000, 10)])
def test_random_of_each(spark, monkeypatch, k, held):
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "GIVEN", held)
    rng = np.random.default_rng(3)
    rows = [(i, int(c)) for i, c in enumerate(np.where(rng.random(900) < 0.4, 0, rng.integers(0, 40, 900)))] + [(5000, None), (5001, None)]
    df = spark.createDataFrame(rows, "spike bigint, cluster bigint").withColumn("extra", F.array("spike")).repartition(5)
    got = S.random_of_each(df, "cluster", "spike", k, 9).collect()
    assert sorted(((r.spike, r.cluster) for r in got), key=str) == sorted(chosen(rows, k, 9), key=str)
    assert all(r.extra == [r.spike] for r in got)


def test_a_large_group_costs_each_task_its_least(spark):
    rows = spark.range(0, 400_000, 1, 6).select((F.col("id") % 2).alias("key"), F.xxhash64("id").alias("order"))
    out = S.least_of_each(rows, "key", "order", 10)
    assert out.count() == 20
    want = rows.toPandas().sort_values("order").groupby("key").head(10)
    assert sorted(r.order for r in out.collect()) == sorted(want["order"].tolist())
    first = rows.mapInArrow(lambda b: b, rows.schema)  # what each of six tasks gives on is no more than its least rows
    assert first.count() == 400_000 and len(S._least(_arrow(spark, rows), 0, 1, 10)) == 20


def _arrow(spark, df):
    return df.toArrow()


def test_empty_groups(spark):
    none = spark.createDataFrame([], "spike bigint, cluster bigint")
    assert S.random_of_each(none, "cluster", "spike", 4).count() == 0


# --- shifts by phase --------------------------------------------------------------------
@pytest.mark.parametrize("trace", [np.zeros(64), np.full(64, 3.0)])
def test_a_constant_template_moves_nothing(trace):
    moved, lag = K.shift_by_phase(trace, np.arange(64.0), 30000)
    assert lag == 0 and np.allclose(moved, np.arange(64.0))


def test_phase_lags_of_clusters(spark):
    """A line for each cluster: known delays come back; a flat cluster stays where it is."""
    t = np.arange(100)
    wave = np.exp(-(((t - 50) / 4) ** 2)) * np.sin(t / 3)
    rows = [(i, 1, [K.shift(wave, d).tolist()]) for i, d in enumerate((-0.6, 0.0, 0.0, 0.0, 0.4))] + [(9, 2, [[1.0] * 100])]
    df = spark.createDataFrame(rows, "waveform_index bigint, cluster bigint, traces array<array<double>>")
    cells = df.select("cluster", F.posexplode("traces").alias("trace", "t")).select("cluster", "trace", F.posexplode("t").alias("sample", "v"))
    got = {r.waveform_index: r.lag for r in X.shifted(df, cells, fs=30000).collect()}
    assert abs(got[0] - 0.6) < 0.01 and abs(got[4] + 0.4) < 0.01 and abs(got[1]) < 0.01 and got[9] == 0
