"""Files that other tools read, written by many tasks: flat matrices and chunk-compressed recordings; hashes of large files.

The data source ``placed_bytes`` writes rows (at, data): each task puts its
bytes at their offsets of one file, on a disk that all executors share.  A new
file is written under another name and renamed when all bytes are there, so a
job that fails leaves none.  An append goes on after the old end; until it is
committed a marker beside the file holds the old length, which is what readers
see and what a job that fails or dies is cut back to.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .recording import RecordingSource, local_path, marker_of, open_file

#: Bytes that a task hashes on its own, those it holds at once, and children of a node of the tree.
HASH_CHUNK, HASH_STEP, HASH_FAN = 64 << 20, 4 << 20, 1024
#: Samples of a range in which blocks' places are summed.
PLACE_RANGE = 1 << 20


@dataclass
class _Written(WriterCommitMessage):
    """Ranges of bytes that a task has written, in order and joined."""

    spans: list[tuple[int, int]]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a == out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class _PlacedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        if "://" in self.path:
            raise ValueError("bytes can be placed in files of a shared disk only; other stores have no writes at offsets")
        self.append = options.get("append", "false").lower() == "true" and os.path.exists(self.path)
        if self.append:
            cut_back(self.path)  # what a job that died has left
            self.base, self.at = os.path.getsize(self.path), self.path
        else:
            self.base, self.at = 0, f"{self.path}.{uuid.uuid4().hex}.part"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        if self.append:
            hold(self.path, self.base)
        spans: list[tuple[int, int]] = []
        file = os.open(self.at, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in iterator:
                for at, data in zip(batch.column("at").to_pylist(), batch.column("data"), strict=True):
                    view = memoryview(data.as_buffer())
                    spans.append((at, at + len(view)))
                    while len(view):
                        done = os.pwrite(file, view, self.base + at)
                        at, view = at + done, view[done:]
                if len(spans) > 1000:
                    spans = _joined(spans)
            os.fsync(file)
        finally:
            os.close(file)
        return _Written(_joined(spans))

    def commit(self, messages: list[_Written | None]) -> None:
        spans = _joined([s for m in messages if m for s in m.spans if s[1] > s[0]])
        if len(spans) > 1 or spans and spans[0][0]:
            self.abort(messages)
            raise ValueError(f"bytes are missing or written twice: {spans[:3]}")
        if self.append:
            release(self.path)
        else:
            os.close(os.open(self.at, os.O_WRONLY | os.O_CREAT, 0o644))
            os.replace(self.at, self.path)

    def abort(self, messages: list[_Written | None]) -> None:
        if self.append:
            cut_back(self.path)
        elif os.path.exists(self.at):
            os.remove(self.at)


def hold(path: str, length: int) -> None:
    """From now on the file counts as ``length`` bytes long, if nothing holds it yet."""
    own = f"{marker_of(path)}.{uuid.uuid4().hex}"
    with open(own, "w") as f:
        f.write(str(length))
    try:
        os.link(own, marker_of(path))  # whole or not at all
    except FileExistsError:
        pass
    finally:
        os.remove(own)


def release(path: str) -> None:
    if os.path.exists(marker_of(path)):
        os.remove(marker_of(path))


def cut_back(path: str) -> None:
    """The file as it was before an append that hasn't been committed."""
    if os.path.exists(marker_of(path)):
        with open(marker_of(path)) as f:
            os.truncate(path, int(f.read()))
        release(path)


class PlacedBytes(DataSource):
    """Sink of rows (at, data).  Options: path, append (after the old end, if there is a file)."""

    @classmethod
    def name(cls) -> str:
        return "placed_bytes"

    def schema(self) -> str:
        return "at bigint, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PlacedWriter(dict(self.options))


def place(rows: DataFrame, path: str, append: bool = False) -> None:
    """Writes rows (at, data) as one file."""
    rows.sparkSession.dataSource.register(PlacedBytes)
    if "://" not in (at := local_path(path)):
        os.makedirs(os.path.dirname(at) or ".", exist_ok=True)
    rows.select("at", "data").write.format("placed_bytes").mode("append").option("append", str(append).lower()).save(path)


def _matrix(group: pd.DataFrame, channels: int, kind: np.dtype, scale: float, whole=np.rint, absent: float | None = None) -> np.ndarray:
    """Samples by channels, of one block's rows (channel, samples): divided by the scale, made whole, within the type's range.

    Channels that the block lacks are an error, or hold ``absent``.
    """
    group = group.sort_values("channel")
    held = group["channel"].tolist()
    if held != list(range(channels)) and (absent is None or len(set(held)) < len(held) or held[0] < 0 or held[-1] >= channels):
        raise ValueError(f"the block has channels {held[:5]}.., not 0 to {channels - 1}, once each")
    rows = [np.asarray(x, float) for x in group["samples"]]
    if len({len(x) for x in rows}) > 1:
        raise ValueError("the block's channels differ in length")
    x = np.stack(rows, 1)
    if len(held) < channels:
        wide = np.full((len(x), channels), absent, float)
        wide[:, held] = x
        x = wide
    x = x / scale
    if kind.kind in "iu":
        x = np.clip(whole(x), np.iinfo(kind).min, np.iinfo(kind).max)
    return x.astype(kind)


def _exists(path: str, append: bool, overwrite: bool) -> None:
    if os.path.exists(local_path(path)) and not append and not overwrite:
        raise FileExistsError(path)


def write_flat(df: DataFrame, path: str, channels: int, scale: float = 1.0, dtype: str = "int16", append: bool = False, overwrite: bool = False, padding: int = 0, truncate: bool = False, absent: float | None = None) -> None:
    """A recording (first_sample, channel, samples) as a flat matrix of samples by channels.

    Values are divided by ``scale``, rounded to the nearest (whole types;
    towards zero with ``truncate``) and clipped to the type.  Blocks may have any lengths, but have to follow each
    other without gaps; every block has all channels from 0, unless those it
    lacks are to hold the value ``absent``.  ``append`` goes
    on after a file's old end, ``padding`` repeats the last sample so often.
    No file is left, or the old one as it was, if a block is missing or a task
    fails.  A task holds one block.
    """
    _exists(path, append, overwrite)
    width, kind = channels * np.dtype(dtype).itemsize, np.dtype(dtype)
    first, last = df.agg(F.min("first_sample"), F.max("first_sample")).first()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, begin = _matrix(group, channels, kind, scale, np.trunc if truncate else np.rint, absent), int(group["first_sample"].iloc[0])
        if padding and begin == last:
            x = np.concatenate([x, np.repeat(x[-1:], padding, 0)])
        return pd.DataFrame({"at": [(begin - first) * width], "data": [x.tobytes()]})

    place(df.select("first_sample", "channel", "samples").groupBy("first_sample").applyInPandas(run, "at bigint, data binary"), path, append)


def write_blocks(df: DataFrame, path: str, scale: float = 1.0, dtype: str = "int16") -> DataFrame:
    """A recording (first_sample, channel, samples) as one file of its blocks, each a flat matrix of its samples by the channels it has; each one's place: first_sample, at, size.

    Where all blocks have all channels, the file is that of :func:`write_flat`.
    Places are sums over ranges of samples and, of these, a row each.
    """
    _exists(path, False, False)
    kind = np.dtype(dtype)
    sizes = df.groupBy("first_sample").agg((F.sum(F.size("samples")) * kind.itemsize).alias("size")).withColumn("range", F.floor(F.col("first_sample") / PLACE_RANGE))
    before = lambda w: F.sum("size").over(w) - F.col("size")
    ranges = sizes.groupBy("range").agg(F.sum("size").alias("size")).select("range", before(Window.orderBy("range")).alias("base"))
    inner = sizes.select("range", "first_sample", "size", before(Window.partitionBy("range").orderBy("first_sample")).alias("inner"))
    places = inner.join(ranges, "range").select("first_sample", (F.col("base") + F.col("inner")).alias("at"), "size")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["channel"].duplicated().any():
            raise ValueError(f"the block at {group['first_sample'].iloc[0]} has a channel twice")
        x = _matrix(group.assign(channel=group["channel"].rank().astype(int) - 1), len(group), kind, scale)
        return pd.DataFrame({"at": group["at"].iloc[:1], "data": [x.tobytes()]})

    rows = df.select("first_sample", "channel", "samples").join(places.select("first_sample", "at"), "first_sample")
    place(rows.groupBy("first_sample").applyInPandas(run, "at bigint, data binary"), path)
    return places


def in_chunks(df: DataFrame, size: int) -> DataFrame:
    """Rows (first_sample, channel, samples) cut where a chunk of ``size`` samples ends: chunk, first_sample, channel, samples."""
    n = F.size("samples")
    ids = F.sequence(F.floor(F.col("first_sample") / size), F.floor((F.col("first_sample") + n - 1) / size))
    cut = df.where(n > 0).select("first_sample", "channel", "samples", F.explode(ids).alias("chunk"))
    begin = F.greatest(F.col("chunk") * size, F.col("first_sample"))
    end = F.least((F.col("chunk") + 1) * size, F.col("first_sample") + F.size("samples"))
    part = F.slice("samples", (begin - F.col("first_sample") + 1).cast("int"), (end - begin).cast("int"))
    return cut.select("chunk", begin.alias("first_sample"), "channel", part.alias("samples"))


def write_chunks(df: DataFrame, path: str, channels: int, fs: float, work: str, scale: float = 1.0, dtype: str = "int16", chunk: int | None = None, time_differences: bool = True, channel_differences: bool = False, level: int = 6, overwrite: bool = False, absent: float | None = None) -> dict:
    """A recording (first_sample, channel, samples) as a chunk-compressed ``.cbin`` file with its ``.ch`` description; returns that.

    Chunks have ``chunk`` samples (a second), cut from blocks of any lengths.
    Each is compressed by one task into a table in the folder ``work``; their
    sizes give every chunk's place, and a second job puts the bytes there.
    Besides the usual entries the description has each chunk's SHA-1.  The
    first sample has to be 0.  Channels that a block lacks hold ``absent``, if given.
    """
    _exists(path, False, overwrite)
    spark, size, kind = df.sparkSession, chunk or int(fs), np.dtype(dtype)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_matrix(one, channels, kind, scale, absent=absent) for _, one in group.groupby("first_sample", sort=True)]
        starts = sorted(group["first_sample"].unique().tolist())
        if any(a + len(x) != b for a, x, b in zip(starts, parts, starts[1:], strict=False)):
            raise ValueError(f"samples are missing or given twice after {starts[0]}")
        x = np.concatenate(parts)
        n = len(x)
        if time_differences:
            x = np.concatenate([x[:1], np.diff(x, axis=0)])
        if channel_differences:
            x = np.concatenate([x[:, :1], np.diff(x, axis=1)], 1)
        data = zlib.compress(np.ascontiguousarray(x).tobytes(), level)
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "first": [starts[0]], "n": [n], "size": [len(data)], "sha1": [hashlib.sha1(data).hexdigest()], "data": [data]})

    shape = "chunk bigint, first bigint, n bigint, size bigint, sha1 string, data binary"
    made = f"{work}/chunks-{uuid.uuid4().hex}"
    in_chunks(df.select("first_sample", "channel", "samples"), size).groupBy("chunk").applyInPandas(run, shape).write.parquet(made)
    chunks = spark.read.schema(shape).parquet(made)
    told = chunks.select("chunk", "first", "n", "size", "sha1").orderBy("chunk").collect()  # the description has them all
    bounds, offsets = np.r_[0, np.cumsum([r.n for r in told])].astype(int).tolist(), np.r_[0, np.cumsum([r["size"] for r in told])].astype(int).tolist()
    if [r["first"] for r in told] != bounds[:-1]:
        raise ValueError("the recording has gaps, or doesn't begin at sample 0")
    out = {"version": "1.0", "algorithm": "zlib", "comp_level": level, "do_time_diff": time_differences, "do_spatial_diff": channel_differences, "dtype": kind.name, "n_channels": channels, "sample_rate": fs, "chunk_bounds": bounds, "chunk_offsets": offsets, "chunk_order": "C", "chunk_sha1": [r.sha1 for r in told]}
    places = spark.createDataFrame([(r.chunk, at) for r, at in zip(told, offsets[:-1], strict=True)], "chunk bigint, at bigint")
    at = local_path(path)
    description = at[: -len(".cbin")] + ".ch" if at.endswith(".cbin") else f"{at}.ch"
    place(chunks.join(places, "chunk").select("at", "data"), path + ".new")
    with open(description + ".new", "w") as f:
        json.dump(out, f)
    os.replace(description + ".new", description)
    os.replace(at + ".new", at)
    return out


def damaged_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk, first_sample, last_sample of the chunks of a ``.cbin`` file whose bytes have another SHA-1 than its description tells."""
    with open_file(path[: -len(".cbin")] + ".ch") as f:
        told = json.loads(f.read())
    b, o = told["chunk_bounds"], told["chunk_offsets"]
    rows = [(i, b[i], b[i + 1], o[i], o[i + 1] - o[i], told["chunk_sha1"][i]) for i in range(len(b) - 1)]
    each = spark.createDataFrame(rows, "chunk bigint, first_sample bigint, last_sample bigint, at bigint, size bigint, told string").withColumn("path", F.lit(path))
    found = _digests(each.repartition(F.col("chunk")), "sha1", "chunk bigint, first_sample bigint, last_sample bigint, told string")
    return found.where("hex(digest) <> upper(told)").select("chunk", "first_sample", "last_sample")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text as one file."""
    place(spark.createDataFrame([(0, text.encode())], "at bigint, data binary"), path)


def to_flat(spark: SparkSession, source: str, path: str, **options) -> None:
    """A recording file (chunk-compressed, or any that the source reads) as a flat one, value by value."""
    spark.dataSource.register(RecordingSource)
    rows = spark.read.format("recording").load(source)
    write_flat(rows, path, rows.agg(F.max("channel")).first()[0] + 1, **options)


# --- hashes ----------------------------------------------------------------------------
def files_under(spark: SparkSession, path: str) -> DataFrame:
    """path and length of files that aren't empty; none is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _digests(rows: DataFrame, algorithm: str, keep: str, prefix: bytes = b"") -> DataFrame:
    """``keep`` columns and the digest of bytes [at, at + size) of each row's file, read in small steps."""
    names = [x.split()[0] for x in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path, at, size in zip(batch.column("path").to_pylist(), batch.column("at").to_pylist(), batch.column("size").to_pylist(), strict=True):
                digest = hashlib.new(algorithm, prefix)
                with open_file(path) as f:
                    f.seek(at)
                    while size:
                        data = f.read(min(size, HASH_STEP))
                        if not data:
                            raise EOFError(f"{path} ends before {at + size}")
                        digest.update(data)
                        size -= len(data)
                made.append(digest.digest())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(made, pa.binary())], names=[*names, "digest"])

    return rows.select(*names, *(c for c in ("path", "at", "size") if c not in names)).mapInArrow(run, f"{keep}, digest binary")


def chunk_hashes(spark: SparkSession, path: str, chunk: int = HASH_CHUNK, ranges: DataFrame | None = None) -> DataFrame:
    """path, chunk, at, size, digest: SHA-256 of a zero byte and each range of ``chunk`` bytes of files, every range a row that any task may take.

    ``ranges`` (chunk, at, size) names those of one file instead.
    """
    shape = "path string, chunk bigint, at bigint, size bigint"
    if ranges is not None:
        told = ranges.select(F.lit(path).alias("path"), "chunk", "at", "size")
        return _digests(told.repartition("chunk"), "sha256", shape, b"\0")
    n = F.ceil(F.col("length") / chunk)
    ranges = files_under(spark, path).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    at = F.col("chunk") * chunk
    ranges = ranges.select("path", "chunk", at.alias("at"), F.least(F.lit(chunk), F.col("length") - at).alias("size"))
    return _digests(ranges.repartition("path", "chunk"), "sha256", shape, b"\0")


def tree_hashes(spark: SparkSession, path: str, chunk: int = HASH_CHUNK, fan: int = HASH_FAN) -> DataFrame:
    """path and root of each file's tree of hashes: ``fan`` children's digests after a one byte make their parent's.

    Two files have one root exactly if they have the same bytes; no task reads
    more than a chunk or holds more than ``fan`` digests.
    """
    files = files_under(spark, path)
    most = files.agg(F.max("length")).first()[0] or 0
    # left: nodes of the file at this level; 0 once its root is made
    nodes = chunk_hashes(spark, path, chunk).join(files, "path").select("path", F.col("chunk").alias("node"), "digest", F.ceil(F.col("length") / chunk).alias("left"))
    left = max(1, -(-most // chunk))
    while True:
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        joined = F.aggregate(children, F.unhex(F.lit("01")), lambda a, x: F.concat(a, x["digest"]))
        made = F.when(F.first("left") == 0, F.first("digest")).otherwise(F.unhex(F.sha2(joined, 256)))
        up = F.ceil(F.col("left") / fan)
        nodes = nodes.groupBy("path", F.floor(F.col("node") / fan).alias("up")).agg(made.alias("digest"), F.first("left").alias("left"))
        nodes = nodes.select("path", F.col("up").alias("node"), "digest", F.when(up > 1, up).otherwise(0).alias("left"))
        left = -(-left // fan)
        if left == 1:
            return nodes.select("path", F.lower(F.hex("digest")).alias("root"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-1 of each file's bytes, as published beside recordings: one task a file, in steps of some MB."""
    whole = files_under(spark, path).select("path", F.lit(0).cast("long").alias("at"), F.col("length").alias("size"))
    return _digests(whole.repartition("path"), "sha1", "path string").select("path", F.lower(F.hex("digest")).alias("sha1"))


def same_as_told(spark: SparkSession, path: str, meta: DataFrame) -> DataFrame:
    """path, sha1, told, same: hashes of files under ``path`` against those in their metadata (path without its suffix, meta)."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    found = file_hashes(spark, path).where(~F.col("path").endswith(".meta")).withColumn("stem", stem(F.col("path")))
    told = meta.select(stem(F.col("path")).alias("stem"), F.lower(F.element_at("meta", F.lit("fileSHA1"))).alias("told"))
    return found.join(told, "stem", "left").select("path", "sha1", "told", (F.col("sha1") == F.col("told")).alias("same"))
