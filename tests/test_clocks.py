"""Distributed clock matching against the array version."""

import numpy as np
import pytest

from tracelake.operators import clocks as C
from tracelake.operators import events as E


def table(spark, sides):
    rows = [(r, s, float(t)) for r, (a, b) in sides.items() for s, x in (("a", a), ("b", b)) for t in x]
    return spark.createDataFrame(rows, "rec bigint, side string, time double").repartition(4)


def clocks(seed, n=120, drift=30e-6, lost=0.1, jitter=0.004):
    rng = np.random.default_rng(seed)
    a = np.sort(rng.uniform(0, n * 1.3, n))
    b = a * (1 + drift) + 12.34 + rng.normal(size=n) * jitter
    more = rng.uniform(b.min(), b.max(), n // 10)
    return np.sort(a[rng.random(n) > lost]), np.sort(np.r_[b[rng.random(n) > lost], more])


@pytest.fixture(scope="module")
def sides():
    out = {k: clocks(k) for k in range(4)}
    out[4] = (np.array([0.0, 5.0, 5.04, 9.0, 20.0]), np.array([0.0, 5.0, 5.04, 9.0, 20.0]) + 2)
    t = np.arange(40.0)  # even steps, ties in the lag and in the gaps
    out[5] = (t, t + 0.05)
    out[6] = (np.repeat(np.arange(9.0) ** 1.5, 2), np.repeat(np.arange(9.0) ** 1.5, 2) + 1.0)  # events at the same time
    out[7] = (np.array([3.0]), np.array([4.0]))
    a, b = clocks(9, 200, lost=0.0)
    keep = (a < 60) | (a > 170)
    out[8] = (a[keep], b[(b < 100) | (b > 140)])  # gaps
    return out


@pytest.mark.parametrize("linear", [False, True])
def test_same_pairs_as_the_array_version(spark, sides, tmp_path, linear):
    got = {}
    for r in C.clock_pairs(table(spark, sides), str(tmp_path), 0.2, linear).collect():
        got.setdefault(r.rec, []).append((r.time_a, r.time_b, r.drift_ppm))
    for rec, (a, b) in sides.items():
        i, j, slope, _ = E.match_clocks(a, b, 0.2, linear)
        found = sorted(got[rec])
        assert [x[:2] for x in found] == sorted(zip(a[i].tolist(), b[j].tolist(), strict=True)), rec
        assert all(abs(x[2] - (slope - 1) * 1e6) < 1e-3 for x in found)


def test_lags(spark, sides):
    got = {r.rec: (r.lag, r.n, r.before, r.after) for r in C.clock_lag(table(spark, sides), 0.2).collect()}
    for rec, (a, b) in sides.items():
        low = min(a.min(), b.min())
        assert got[rec] == tuple(E._best_lag(*(np.unique(((t - low) / 0.2).astype(int)) for t in (a, b))))


def test_lags_of_a_long_span_from_coarse_to_fine(spark):
    """More bins than a task may see: the same lag by joined bins, and a recording with one side has none."""
    rng = np.random.default_rng(5)
    a = np.sort(rng.uniform(0, 4e5, 300))
    df = table(spark, {1: (a, a + 777.7), 2: (a, a[:0]), 3: (a[:50], a[:40] - 5000.3)})
    got = {r.rec: (r.lag, r.n, r.before, r.after) for r in C.clock_lag(df, 0.1, most=4096).collect()}
    want = {r.rec: (r.lag, r.n, r.before, r.after) for r in C.clock_lag(df, 0.1).collect()}
    assert got == want and set(got) == {1, 3} and abs(got[1][0] + 7777) <= 1


def test_no_group_of_a_recording(spark, tmp_path):
    """What is brought together by recording alone: counts of bins, of which there are a bounded number, and rows of cells."""
    plan = C.clock_lag(table(spark, {1: clocks(1)}), 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan and "collect_list" not in plan


def test_nothing_to_match(spark, tmp_path):
    assert C.clock_pairs(table(spark, {1: (np.array([1.0]), np.zeros(0))}), str(tmp_path)).count() == 0


def test_few_events_over_a_long_span_need_no_transform(monkeypatch):
    rng = np.random.default_rng(7)
    x, y = (np.unique(rng.integers(0, 60, 40)) for _ in "ab")
    nx, ny = rng.integers(1, 5, len(x)), rng.integers(1, 5, len(y))
    want = {}
    for i, n in zip(x.tolist(), nx.tolist(), strict=True):
        for j, m in zip(y.tolist(), ny.tolist(), strict=True):
            want[i - j] = want.get(i - j, 0) + n * m
    held = lambda made: {k: n for k, n in zip(*(c.tolist() for c in made), strict=True) if n}
    assert held(C._products(x, y, nx, ny)) == want  # by transform
    monkeypatch.setattr(np.fft, "rfft", None)
    assert held(C._products(x * 1000, y * 1000, nx, ny)) == {k * 1000: n for k, n in want.items()}
    few = held(C._products(np.array([3, 500_000, 900_000]), np.array([0, 499_997]), np.ones(3, int), np.ones(2, int)))
    assert few == {3: 2, 500_000: 1, 900_000: 1, -499_994: 1, 400_003: 1}


def test_few_events_and_those_close_together(spark, tmp_path):
    """Clocks without losses: each event has its own image, however few there are or near to each other."""
    rng, month = np.random.default_rng(11), 2.6e6
    few = {r: np.sort(rng.uniform(0, month, 2 + r % 3)) for r in range(24)}
    images = {r: (a, a * (1 + 17.14e-6) + 34.323) for r, a in few.items()}
    got = C.clock_pairs(table(spark, images), str(tmp_path / "few"), 60.0).collect()
    assert len(got) == sum(map(len, few.values())) and all(abs(r.drift_ppm - 17.14) < 1e-3 for r in got)
    for r, (a, b) in images.items():
        i, j, slope, _ = E.match_clocks(a, b, 60.0)
        assert i.tolist() == j.tolist() == list(range(len(a))) and abs((slope - 1) * 1e6 - 17.14) < 1e-3
    a = {r: np.sort(np.r_[rng.uniform(0, month, 60), month * 0.8 + np.array([0.0, 0.7, 3.5]) + 40 * r]) for r in range(12)}
    images = {r: (x, x * 1.000001 + 3) for r, x in a.items()}
    got = C.clock_pairs(table(spark, images), str(tmp_path / "near"), 10.0).collect()
    assert {(r.rec, r.time_a, r.time_b) for r in got} == {(r, t, u) for r, (x, y) in images.items() for t, u in zip(x.tolist(), y.tolist(), strict=True)}


def test_wide_lags_of_joined_bins(spark):
    rng = np.random.default_rng(5)
    a = np.sort(rng.uniform(0, 4e5, 300))
    df = table(spark, {1: (a, a * 1.000001 + 777.7), 3: (a[:50], a[:40] - 5000.3)})
    got = {r.rec: (r.lag, r.n, r.before, r.after) for r in C.clock_lag(df, 0.1, most=4096, wide=True).collect()}
    assert got == {r.rec: (r.lag, r.n, r.before, r.after) for r in C.clock_lag(df, 0.1, wide=True).collect()}
