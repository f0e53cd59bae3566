"""Conversion by version and shanks: files, metadata, low band against numpy, refusals."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.functions import kernels as K
from tracelake.plans import convert as C
from tracelake.sources import files as FL
from tracelake.sources import metadata as M

NC, NS = 9, 1000


def made(spark, folder, kind=24, shanks=2, more=""):
    x = (np.cumsum(np.random.default_rng(3).normal(size=(NS, NC)) * 40, 0)).astype(np.int16)
    x[:, -1] = np.arange(NS) // 7 % 2 * 64
    x.tofile(folder / "m.ap.bin")
    sites = "".join(f"({i % shanks}:{i % 2}:{i // 2}:1)" for i in range(NC - 1))
    (folder / "m.ap.meta").write_text(f"typeThis=imec\nimDatPrb_type={kind}\nimSampRate=30000\nnSavedChans={NC}\nsnsApLfSy={NC - 1},0,1\nacqApLfSy={NC - 1},0,1\nsnsSaveChanSubset=0:{NC - 1}\n~snsShankMap=({shanks},2,9){sites}\n{more}")
    return x, str(folder / "m.ap.bin")


def low(x):
    y = K.sosfiltfilt(K.butterworth(C.ORDER, C.CORNER, "lowpass"), x[:, :-1].T.astype(float))[:, ::12]
    return np.concatenate([np.trunc(y).T, x[::12, -1:]], 1).astype(np.int16)


@pytest.mark.parametrize("block", [60_000, 600])
def test_split_by_shank(spark, tmp_path, block):
    x, at = made(spark, tmp_path)
    status, files = C.convert(spark, at, str(tmp_path / "out"), block=block)
    assert status == C.DONE and set(files) == {(s, b) for s in (0, 1) for b in ("ap", "lf")}
    for (s, band), file in files.items():
        mine = [*range(s, NC - 1, 2), NC - 1]
        want = (x if band == "ap" else low(x))[:, mine]
        got = np.fromfile(file, np.int16).reshape(-1, len(mine))
        assert (got == want).all() if band == "ap" or block > NS else np.abs(got.astype(int) - want).max() <= 1
        meta = M.read(spark, file.removesuffix(".bin") + ".meta").first().meta
        assert meta["snsApLfSy"] == ("4,0,1" if band == "ap" else "0,4,1") and meta["nSavedChans"] == "5" and meta["NP2.4_shank"] == str(s)
        assert meta["snsSaveChanSubset"] == "0:4" and meta["snsSaveChanSubset_orig"] == ("0,2,4,6,8" if s == 0 else "1,3,5,7:8")
        assert meta["fileSizeBytes"] == str(os.path.getsize(file)) and float(meta["imSampRate"]) == (30000 if band == "ap" else 2500) and meta["original_meta"] == "False"
    assert C.convert(spark, at, str(tmp_path / "out"))[0] == C.NOTHING
    assert C.convert(spark, files[0, "ap"], str(tmp_path / "again"))[0] == C.NOTHING and not (tmp_path / "again").exists()
    assert C.convert(spark, at, str(tmp_path / "out"), overwrite=True, block=block)[0] == C.DONE


@pytest.mark.parametrize("kind", [21, 24])
def test_one_shank_gives_its_low_band_alone(spark, tmp_path, kind):
    x, at = made(spark, tmp_path, kind, 1)
    status, files = C.convert(spark, at, str(tmp_path))
    assert status == C.DONE and files == {(0, "lf"): str(tmp_path / "m.lf.bin")}
    assert (np.fromfile(files[0, "lf"], np.int16).reshape(-1, NC) == low(x)).all()
    meta = M.read(spark, str(tmp_path / "m.lf.meta")).first().meta
    assert meta["NP2.1_shank"] == "0" and meta["nSavedChans"] == str(NC) and "snsSaveChanSubset_orig" not in meta


def test_what_is_not_converted(spark, tmp_path):
    _, at = made(spark, tmp_path, 0, 1)
    assert C.convert(spark, at, str(tmp_path / "out")) == (C.UNKNOWN, {})
    (tmp_path / "b").mkdir()
    _, at = made(spark, tmp_path / "b", 24, 2, "NP2.4_shank=1\n")
    assert C.convert(spark, at, str(tmp_path / "out")) == (C.NOTHING, {}) and not (tmp_path / "out").exists()


def test_a_damaged_part_is_told(spark, tmp_path):
    x, at = made(spark, tmp_path)
    _, files = C.convert(spark, at, str(tmp_path / "out"), block=100)
    rows = spark.read.format("recording").option("channels", NC).option("block", 100).load(at)
    mine = [*range(0, NC - 1, 2), NC - 1]
    assert C.differing(spark, rows, files[0, "ap"], mine, 100) == 0
    with open(files[0, "ap"], "r+b") as f:
        f.seek(len(mine) * 2 * 250)
        f.write(b"\x7f\x7f")
    assert C.differing(spark, rows, files[0, "ap"], mine, 100) == 1
    os.truncate(files[0, "ap"], len(mine) * 2 * 900)
    assert C.differing(spark, rows, files[0, "ap"], mine, 100) == 1 + len(mine)
    assert rows.agg(F.max("channel")).first()[0] == NC - 1


def test_runs_of_channels():
    assert M.as_runs([0, 1, 2, 3, 7]) == "0:3,7" and M.as_runs([]) == "" and M.as_runs([5, 4, 9]) == "4:5,9"


def test_truncation(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, [0.9, -0.9, 1.5, -1.5])], "first_sample bigint, channel bigint, samples array<double>")
    FL.write_flat(rows, str(tmp_path / "a.bin"), 1, truncate=True)
    assert np.fromfile(tmp_path / "a.bin", np.int16).tolist() == [0, 0, 1, -1]
