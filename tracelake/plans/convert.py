"""Conversion of recordings that hold both bands in one file: split by shank, low band extracted, metadata patched, checked."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import kernels as K
from ..operators import voltage as V
from ..sources import files as FL
from ..sources import metadata as M
from ..sources import recording as R
from .files import held
from .jobs import _folder

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Samples of the low band's one, order and corner (of half the rate) of its filter, samples of neighbours that it sees.
RATIO, ORDER, CORNER, MARGIN = 12, 2, 0.2, 576
#: What became of a recording.
UNKNOWN, NOTHING, DONE = -1, 0, 1


def facts(spark: SparkSession, meta: str) -> dict:
    """Of one metadata file: its map of texts, version, saved channels, sync channels, each site's shank, and whether it is a part already."""
    told = M.read(spark, meta)
    row = told.select("meta", M.version(F.col("meta")).alias("version"), M.number(F.col("meta"), "nSavedChans").cast("int").alias("n"), M.sync_channels(F.col("meta")).alias("sync"), M.rate(F.col("meta")).alias("fs")).first()
    shanks = {r.ind: r.shank for r in M.geometry(told).select("ind", "shank").collect()}  # a probe's sites
    done = any(k in row.meta for k in (f"{row.version}_shank", "NP2.4_shank", f"{M.SINGLE}_shank"))
    return {"meta": dict(row.meta), "version": row.version, "n": row.n, "sync": list(row.sync), "fs": row.fs, "shanks": shanks, "done": done}


def low_band(df: DataFrame, sync: list[int], ratio: int = RATIO, margin: int = MARGIN) -> DataFrame:
    """Every ``ratio``-th sample of rows (block, channel, first_sample, samples), of the sites' after a zero-phase low-pass that sees the neighbours."""
    sos = K.butterworth(ORDER, CORNER, "lowpass")
    is_sync = F.col("channel").isin(sync) if sync else F.lit(False)
    sites = df.where(~is_sync).withColumn("samples", F.transform("samples", lambda x: x.cast("double")))
    low = V.in_margins(sites, lambda x: V.along_time(x, lambda a: K.sosfiltfilt(sos, a)[..., ::ratio]), margin, ratio)
    picked = df.where(is_sync).withColumn("samples", F.transform(F.filter("samples", lambda x, i: i % ratio == 0), lambda x: x.cast("double")))
    return low.unionByName(picked).withColumn("first_sample", F.floor(F.col("first_sample") / ratio))


def _part(df: DataFrame, channels: list[int]) -> DataFrame:
    """Rows of some channels, numbered from 0."""
    number = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(channels) for x in (c, i))), F.col("channel").cast("int"))
    return df.where(F.col("channel").isin(channels)).withColumn("channel", number.cast("long"))


def convert(spark: SparkSession, path: str, out: str, meta: str | None = None, overwrite: bool = False, block: int = 60_000, check: bool = True) -> tuple[int, dict]:
    """Converts a flat recording by its version; what became of it, and the files made: ``{(shank, band): path}``.

    Probes with several shanks (NP2.4, NP2QB) give ``shank<k>/<name>.ap.bin``
    and ``.lf.bin`` for each under ``out``, sync traces with every one; those
    with one shank (NP2.1 too) give ``<name>.lf.bin`` alone.  Each file has its
    metadata beside it.  The low band is every twelfth sample of the filtered
    whole numbers, cut to whole ones.  Recordings that are parts already, and
    files that are there (unless ``overwrite``), are left alone (0); other
    versions aren't known (-1).  ``check`` compares the parts with the
    original, and raises an error if a value differs.  Shanks are four at most
    and converted one after the other; each file is written by many tasks.
    """
    block = -(-block // RATIO) * RATIO  # blocks of whole samples of the low band
    told = facts(spark, meta or path.rsplit(".", 1)[0] + ".meta")
    if told["version"] not in ("NP2.1", "NP2.4", "NP2QB"):
        return UNKNOWN, {}
    if told["done"]:
        return NOTHING, {}
    shanks = sorted(set(told["shanks"].values())) or [0]
    split = told["version"] != "NP2.1" and len(shanks) > 1
    name = path.rsplit("/", 1)[1].removesuffix(".bin")
    stem = name.removesuffix(".ap")
    files = {(k, b): f"{out}/shank{k}/{stem}.{b}.bin" for k in shanks for b in ("ap", "lf")} if split else {(shanks[0], "lf"): f"{out}/{stem}.lf.bin"}
    if not overwrite and any(os.path.exists(R.local_path(f)) for f in files.values()):
        return NOTHING, files
    spark.dataSource.register(R.RecordingSource)
    rows = spark.read.format("recording").option("channels", told["n"]).option("block", block).load(path)
    low = low_band(rows, told["sync"])
    for (k, band), file in files.items():
        channels = [c for c, s in told["shanks"].items() if s == k or not split] + told["sync"]
        FL.write_flat(_part(rows if band == "ap" else low, channels), file, len(channels), overwrite=True, truncate=True)
        patched = M.for_part(told["meta"], channels, len(told["sync"]), band, k, os.path.getsize(R.local_path(file)), told["fs"] / (1 if band == "ap" else RATIO), split)
        FL.write_text(spark, "".join(f"{a}={b}\n" for a, b in sorted(patched.items())), file.removesuffix(".bin") + ".meta")
        if check and band == "ap" and (wrong := differing(spark, rows, file, channels, block)):
            raise ValueError(f"{wrong} blocks of shank {k} differ from the original")
    return DONE, files


def differing(spark: SparkSession, rows: DataFrame, file: str, channels: list[int], block: int) -> int:
    """Blocks of channels that a part's file lacks, has otherwise or has besides those of the original."""
    made = spark.read.format("recording").option("channels", len(channels)).option("block", block).load(file)
    both = _part(rows, channels).select("block", "channel", "samples").join(made.select("block", "channel", F.col("samples").alias("made")), ["block", "channel"], "full")
    return both.where(~F.col("samples").eqNullSafe(F.col("made"))).count()


def _mock(spark, d, version: str, shanks: int) -> str:
    """The signal as a recording of 99 sites and a sync trace, with its metadata."""
    at = f"{_folder(spark, 'convert')}/m.ap.bin"
    rows = views.signal(spark, d).select((F.col("block") * 64).alias("first_sample"), "channel", "samples")
    FL.write_flat(rows, at, 100, scale=0.001, absent=0.0)
    kind = {"NP2.4": 24, "NP2.1": 21, "NP1": 0}[version]
    sites = "".join(f"({i * shanks // 99}:{i % 2}:{i // 2}:1)" for i in range(99))
    text = f"typeThis=imec\nimDatPrb_type={kind}\nimSampRate=30000\nnSavedChans=100\nsnsApLfSy=99,0,1\nacqApLfSy=99,0,1\nsnsSaveChanSubset=0:99\n~snsShankMap=({shanks},2,50){sites}\n"
    FL.write_text(spark, text, at.removesuffix(".bin") + ".meta")
    return at


def converted_shanks(spark, d):
    """Files of four shanks: their channels' sums, with the channel of the original."""
    at = _mock(spark, d, "NP2.4", 4)
    _, files = convert(spark, at, f"{at}.out", block=96)
    out = None
    for (k, band), file in files.items():
        if band == "ap":
            meta = M.read(spark, file.removesuffix(".bin") + ".meta").select(F.split(M.text(F.col("meta"), "snsSaveChanSubset_orig"), ",").alias("runs"))
            runs = F.transform("runs", lambda r: F.sequence(F.split(r, ":")[0].cast("long"), F.element_at(F.split(r, ":"), -1).cast("long")))
            original = meta.select(F.posexplode(F.flatten(runs)).alias("channel", "original")).withColumn("channel", F.col("channel").cast("long"))
            n = len([c for c in range(99) if c * 4 // 99 == k]) + 1
            part = spark.read.format("recording").option("channels", n).option("block", 50).load(file)
            told = held(part.join(original, "channel").select("first_sample", F.col("original").alias("channel"), "samples"), views.signal(spark, d))
            sums = told.groupBy("channel").agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).cast("long").alias("total"), F.sum(F.size("samples")).alias("n"))
            one = sums.select(F.lit(k).cast("long").alias("shank"), "channel", "n", "total")
            out = one if out is None else out.unionByName(one)
    return out


def conversion_routes(spark, d):
    """What becomes of recordings by version and number of shanks, and how many files and low-band samples there are."""
    rows = []
    for version, shanks in (("NP2.4", 4), ("NP2.4", 1), ("NP2.1", 1), ("NP1", 1)):
        at = _mock(spark, d, version, shanks)
        status, files = convert(spark, at, f"{at}.out", block=96, check=False)
        again, _ = convert(spark, at, f"{at}.out", block=96, check=False)
        size = sum(os.path.getsize(R.local_path(f)) for (_, b), f in files.items() if b == "lf") // 2
        part, _ = convert(spark, next(iter(files.values())), f"{at}.more") if files else (UNKNOWN, {})
        rows.append((version, shanks, status, again, part, len(files), size))
    return spark.createDataFrame(rows, "version string, shanks long, status long, again long, of_a_part long, files long, low_values long")


QUERIES |= {f.__name__: f for f in (converted_shanks, conversion_routes)}
SQL["converted_shanks"] = f"""WITH {views.SIGNAL}, whole AS (SELECT channel, greatest(-32768, least(32767, round_even(v / 0.001::DOUBLE, 0)))::BIGINT AS v FROM sig)
SELECT s AS shank, channel, count(*) AS n, sum(v)::BIGINT AS total FROM whole, range(4) t(s) WHERE channel = 99 OR channel * 4 // 99 = s GROUP BY 1, 2"""
SQL["conversion_routes"] = """WITH n AS (SELECT ceil((max(vec_id // 100) + 1) * 64 / 12)::BIGINT AS n FROM embeddings), r(version, shanks, status, again, of_a_part, files, per) AS (VALUES ('NP2.4', 4, 1, 0, 0, 8, 103), ('NP2.4', 1, 1, 0, 0, 1, 100), ('NP2.1', 1, 1, 0, 0, 1, 100), ('NP1', 1, -1, -1, -1, 0, 0))
SELECT version, shanks::BIGINT AS shanks, status::BIGINT AS status, again::BIGINT AS again, of_a_part::BIGINT AS of_a_part, files::BIGINT AS files, (per * n)::BIGINT AS low_values FROM r, n"""
