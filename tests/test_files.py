"""Files that many tasks write, filters that the source takes over, hashes of large files."""

import hashlib
import json
import os
import resource
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.sources import files as FL
from tracelake.sources import recording as R

NC = 7


def matrix(ns, seed=1):
    return np.random.default_rng(seed).integers(-30000, 30000, (ns, NC)).astype(np.int16)


def blocks(spark, x, sizes, scale=1.0, first=0):
    """Rows (first_sample, channel, samples) of blocks of these sizes, dealt over as many tasks."""
    rows, at = [], 0
    for n in sizes:
        rows += [(first + at, c, [float(v) * scale for v in x[at : at + n, c]]) for c in range(NC)]
        at += n
    return spark.createDataFrame(rows, "first_sample bigint, channel bigint, samples array<double>").repartition(len(sizes))


def left_over(folder):
    return sorted(x for x in os.listdir(folder) if not x.startswith("."))


@pytest.fixture(scope="module", autouse=True)
def many_tasks(spark):
    spark.dataSource.register(R.RecordingSource)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("sizes", [[50] * 8, [13, 87, 1, 200, 99]])
def test_flat_file_of_many_tasks(spark, tmp_path, sizes):
    x, at = matrix(sum(sizes)), str(tmp_path / "a.bin")
    FL.write_flat(blocks(spark, x, sizes, 2.34e-6), at, NC, scale=2.34e-6)
    assert open(at, "rb").read() == x.tobytes() and left_over(tmp_path) == ["a.bin"]
    with pytest.raises(FileExistsError):
        FL.write_flat(blocks(spark, x, sizes), at, NC)
    FL.write_flat(blocks(spark, -x, sizes, 1, 1000), at, NC, overwrite=True)  # a first sample other than 0
    assert open(at, "rb").read() == (-x).tobytes()
    back = spark.read.format("recording").option("channels", NC).option("block", 64).load(at)
    got = {(r.channel, r.first_sample): r.samples for r in back.collect()}
    for (c, first), samples in got.items():
        assert samples == (-x[first : first + 64, c]).tolist()


def test_rounds_and_clips(spark, tmp_path):
    rows = [(0, c, [0.4, 0.6, -1.6, 1e9, -1e9]) for c in range(2)]
    FL.write_flat(spark.createDataFrame(rows, "first_sample bigint, channel bigint, samples array<double>"), str(tmp_path / "a.bin"), 2)
    assert np.fromfile(tmp_path / "a.bin", np.int16).reshape(-1, 2)[:, 0].tolist() == [0, 1, -2, 32767, -32768]


def test_append_and_padding(spark, tmp_path):
    x, y, at = matrix(90), matrix(70, 2), str(tmp_path / "a.bin")
    FL.write_flat(blocks(spark, x, [30] * 3), at, NC, append=True)  # nothing there yet
    FL.write_flat(blocks(spark, y, [50, 20], first=90), at, NC, append=True, padding=11)
    want = np.concatenate([x, y, np.repeat(y[-1:], 11, 0)])
    assert np.fromfile(at, np.int16).reshape(-1, NC).tolist() == want.tolist() and left_over(tmp_path) == ["a.bin"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    def broken(samples, first):
        if first >= 100:
            raise RuntimeError("this block can't be made")
        return samples

    x, at = matrix(160), str(tmp_path / "a.bin")
    rows = blocks(spark, x, [20] * 8)
    bad = rows.withColumn("samples", F.udf(broken, "array<double>")("samples", "first_sample"))
    with pytest.raises(Exception, match="can't be made"):
        FL.write_flat(bad, at, NC)
    assert left_over(tmp_path) == []
    for lost in ("first_sample <> 40", "channel <> 3"):
        with pytest.raises(Exception, match="missing|has channels"):
            FL.write_flat(rows.where(lost), at, NC)
        assert left_over(tmp_path) == []
    FL.write_flat(rows, at, NC)
    with pytest.raises(Exception, match="can't be made"):
        FL.write_flat(bad, at, NC, append=True)
    assert open(at, "rb").read() == x.tobytes() and left_over(tmp_path) == ["a.bin"]


def test_readers_dont_see_an_append_before_its_commit(spark, tmp_path):
    x, at = matrix(40), str(tmp_path / "a.bin")
    x.tofile(at)
    FL.hold(at, os.path.getsize(at))
    FL.hold(at, 3)  # a second task's doesn't count
    with open(at, "ab") as f:
        f.write(b"half a")
    assert spark.read.format("recording").option("channels", NC).load(at).agg(F.sum(F.size("samples"))).first()[0] == x.size
    FL.write_flat(blocks(spark, x, [40]), at, NC, append=True)  # after a job that died: from the old end
    assert open(at, "rb").read() == x.tobytes() * 2 and left_over(tmp_path) == ["a.bin"]


@pytest.mark.parametrize("time, channel", [(True, False), (True, True), (False, False)])
def test_chunk_compressed_round_trip(spark, tmp_path, time, channel):
    x, at = matrix(230), str(tmp_path / "a.cbin")
    told = FL.write_chunks(blocks(spark, x, [45, 100, 5, 80]), at, NC, 30.0, str(tmp_path / "work"), time_differences=time, channel_differences=channel)
    assert told["chunk_bounds"] == [0, 30, 60, 90, 120, 150, 180, 210, 230] and told == json.load(open(tmp_path / "a.ch"))
    assert told["chunk_offsets"][-1] == os.path.getsize(at) and left_over(tmp_path) == ["a.cbin", "a.ch", "work"]
    raw = np.frombuffer(zlib.decompress(open(at, "rb").read()[: told["chunk_offsets"][1]]), np.int16).reshape(-1, NC)
    first = np.diff(x[:30], axis=0, prepend=np.zeros((1, NC), np.int16)) if time else x[:30]
    first = np.diff(first, axis=1, prepend=np.zeros((30, 1), np.int16)) if channel else first
    assert (raw == first).all()
    FL.to_flat(spark, at, str(tmp_path / "b.bin"))
    assert open(tmp_path / "b.bin", "rb").read() == x.tobytes()
    assert FL.damaged_chunks(spark, at).count() == 0
    with open(at, "r+b") as f:
        f.seek(told["chunk_offsets"][3] + 5)
        f.write(b"\xff\x00")
    assert [tuple(r) for r in FL.damaged_chunks(spark, at).collect()] == [(3, 90, 120)]


def test_chunks_of_a_recording_with_a_gap_are_refused(spark, tmp_path):
    rows = blocks(spark, matrix(120), [20] * 6)
    for lost in ("first_sample <> 40", "first_sample >= 60"):
        with pytest.raises(Exception, match="missing|gaps"):
            FL.write_chunks(rows.where(lost), str(tmp_path / "a.cbin"), NC, 50.0, str(tmp_path / "work"))
    assert left_over(tmp_path) == ["work"]


# --- filters ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("flat") / "a.bin")
    matrix(1000).tofile(at)
    return at


def test_two_conditions_on_one_load(spark, flat):
    """A load that doesn't push may be used under any number of conditions; loads that push are one's own."""
    rows = spark.read.format("recording").option("channels", NC).option("block", 100).load(flat)
    both = rows.where("channel = 1").union(rows.where("channel <> 1"))
    assert both.count() == 10 * NC
    pushed = R.pushed(spark, flat, "channel = 1", channels=NC, block=100).union(R.pushed(spark, flat, "channel = 2", channels=NC, block=100))
    assert {r.channel for r in pushed.collect()} == {1, 2}


def spans_read(df):
    """Partitions that gave rows, and bytes read for them."""
    each = df.select("first_sample", "read_bytes").groupBy("first_sample").agg(F.first("read_bytes").alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return each[0], each[1] or 0


@pytest.mark.parametrize(
    "where, firsts, channels",
    [
        ("channel IN (1, 4) AND first_sample >= 800", [800, 900], [1, 4]),
        ("first_sample < 200", [0, 100], range(NC)),
        ("first_sample > 100 AND first_sample <= 300 AND channel = 6", [200, 300], [6]),
        ("block IN (3, 7)", [300, 700], range(NC)),
        ("channel = 99", [], []),
        ("first_sample > 100 AND size(samples) = 3", [], []),
        ("first_sample + 1 = 501", [500], range(NC)),
        ("channel <> 2 AND first_sample = 0", [0], [0, 1, 3, 4, 5, 6]),
        ("first_sample IS NOT NULL AND channel <=> 3", range(0, 1000, 100), [3]),
    ],
)
def test_filters_leave_out_bytes(spark, flat, where, firsts, channels):
    got = R.pushed(spark, flat, where, channels=NC, block=100, read_bytes="true")
    assert {(r.first_sample, r.channel) for r in got.collect()} == {(f, c) for f in firsts for c in channels}
    assert spans_read(got)[1] == 2 * NC * 100 * len(firsts)


def test_partitions_follow_the_filters(spark, flat):
    rows = spark.read.format("recording").option("channels", NC).option("block", 100).load(flat)
    assert rows.rdd.getNumPartitions() == 10
    assert R.pushed(spark, flat, "channel IN (1, 2) AND first_sample >= 700", channels=NC, block=100).rdd.getNumPartitions() == 3
    file = R._PushReader({"path": flat, "channels": str(NC), "block": "100"})
    rest = list(file.pushFilters([R.GreaterThan(("first_sample",), 150), R.EqualTo(("samples",), 1), R.In(("channel",), (2, None))]))
    assert [r.attribute for r in rest] == [("samples",)] and [s.first for s in file.partitions()] == list(range(200, 1000, 100))
    batch = next(iter(file.read(file.partitions()[0])))
    assert batch.column("channel").to_pylist() == [2] and file.file.read_bytes == 2 * NC * 100


# --- hashes ----------------------------------------------------------------------------
def root_of(data, chunk, fan):
    level = [hashlib.sha256(b"\0" + data[i : i + chunk]).digest() for i in range(0, max(len(data), 1), chunk)]
    while True:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + fan])).digest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0].hex()


def test_tree_and_whole_hashes(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    made = {"a": os.urandom(64 * 9), "b": b"x" * 64, "c": os.urandom(1000), "d": os.urandom(65)}
    for k, v in made.items():
        (tmp_path / k).write_bytes(v)
    name = lambda r: r.path.rsplit("/", 1)[1]
    for fan in (2, 3, 1024):
        assert {name(r): r.root for r in FL.tree_hashes(spark, str(tmp_path), 64, fan).collect()} == {k: root_of(v, 64, fan) for k, v in made.items()}
    assert {name(r): r.sha1 for r in FL.file_hashes(spark, str(tmp_path)).collect()} == {k: hashlib.sha1(v).hexdigest() for k, v in made.items()}


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Sparse; hashed in ranges, in workers that hold some MB (their peak is told by the tasks)."""

    def peak(batches):
        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss]})

    at, size = tmp_path / "large.bin", 3 * 10**9
    with open(at, "wb") as f:
        f.truncate(size)
    before = spark.range(4).repartition(4).mapInPandas(peak, "kb long").agg(F.max("kb")).first()[0]
    tree = FL.tree_hashes(spark, str(at)).first().root
    after = spark.range(4).repartition(4).mapInPandas(peak, "kb long").agg(F.max("kb")).first()[0]
    step = b"\0" * (64 << 20)
    whole, last = divmod(size, 64 << 20)
    leaf, tail = hashlib.sha256(b"\0" + step).digest(), hashlib.sha256(b"\0" + step[:last]).digest()
    assert tree == hashlib.sha256(b"\1" + leaf * whole + tail).hexdigest()
    assert after - before < 100_000
