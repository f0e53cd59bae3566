"""Recordings on disk as a data source, batch and streaming.

``spark.dataSource.register(RecordingSource)``, then
``spark.read.format("recording").option("channels", 385).load(path)`` gives
rows block, channel, first_sample, samples.  The file is a flat matrix of
samples by channels (int16 by default), a ``.npy`` matrix, or a chunk-compressed
file with its ``.ch`` description, on a local disk or in a store that pyarrow
opens by its address.  A partition is a range of samples; the driver reads no
more than the file's size (or its description).  Options ``first``, ``last``
(samples) and ``only`` (channels, as ``0:3,7``) keep the rest from being read,
and so do filters on block, first_sample and channel with the option ``push``
(and ``spark.sql.python.filterPushdown.enabled``): ranges and sets of the first
two leave out partitions, those of channels rows.  Spark keeps one reader for
each ``load``, with the filters that came last, so a load that pushes is for one
condition; :func:`pushed` loads anew for each.
:func:`read_recording` joins the metadata beside a file: volts and sites.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "block bigint, channel bigint, first_sample bigint, samples array<float>"
#: Without a description, channels are told from the file's size: with or without a sync trace.
GUESSES = (385, 384)


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def marker_of(path: str) -> str:
    """Beside a file that is being appended to: holds the length that counts till then."""
    return f"{path}.appending"


def open_file(path: str):
    """A file to read, on a disk or in a store that pyarrow opens by its address."""
    path = local_path(path)
    if "://" not in path:
        return open(path, "rb")
    from pyarrow.fs import FileSystem

    system, at = FileSystem.from_uri(path)
    return system.open_input_file(at)


class Span(InputPartition):
    """Samples [first, last) of a file."""

    def __init__(self, block: int, first: int, last: int):
        self.block, self.first, self.last = block, first, last


class _Test:
    """A filter on a column of whole numbers."""

    def __init__(self, op: type, value):
        self.op, self.value = op, value

    def __call__(self, x: int) -> bool:
        if self.op in (EqualTo, EqualNullSafe):
            return x == self.value
        if self.op is In:
            return x in self.value
        if self.op is GreaterThan:
            return x > self.value
        if self.op is GreaterThanOrEqual:
            return x >= self.value
        return x < self.value if self.op is LessThan else x <= self.value


class _File:
    """Layout of a recording: where its samples are."""

    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.dtype = np.dtype(options.get("dtype", "int16"))
        self.size = int(options.get("block", 8192))
        self.scale = float(options.get("scale", 1.0))
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None
        self.only = _channels(options["only"]) if "only" in options else None
        self.counted = options.get("read_bytes", "false").lower() == "true"
        self.tests: list[tuple[str, _Test]] = []
        self.offset, self.chunks, self.read_bytes = 0, None, 0
        self.bytes = self._size()
        if self.path.endswith(".npy"):
            with self._open() as f:
                version = np.lib.format.read_magic(f)
                shape, fortran, self.dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                if fortran:
                    raise ValueError("a matrix in column order can't be read by ranges of samples")
                self.channels, self.offset = shape[1], f.tell()
        elif self.path.endswith(".cbin"):
            with self._open(self.path[: -len(".cbin")] + ".ch") as f:
                self.chunks = json.loads(f.read())
            self.channels, self.dtype = self.chunks["n_channels"], np.dtype(self.chunks["dtype"])
        elif "channels" in options:
            self.channels = int(options["channels"])
        else:
            size = self.bytes // self.dtype.itemsize
            self.channels = next((c for c in GUESSES if size % c == 0), 0)
            if not self.channels:
                raise ValueError(f"the number of channels of {self.path} can't be told from its size")

    def _open(self, path: str | None = None):
        return open_file(path or self.path)

    def _size(self) -> int:
        if "://" not in self.path and os.path.exists(marker_of(self.path)):
            try:
                with open(marker_of(self.path)) as f:
                    return int(f.read())
            except FileNotFoundError:  # committed meanwhile
                pass
        with self._open() as f:
            return f.seek(0, 2)

    def length(self) -> int:
        if self.chunks:
            return self.chunks["chunk_bounds"][-1]
        self.bytes = self._size()
        return (self.bytes - self.offset) // (self.channels * self.dtype.itemsize)

    def spans(self, first: int, last: int) -> list[Span]:
        first, last = max(first, self.first), last if self.last is None else min(last, self.last)
        if self.chunks:
            bounds = self.chunks["chunk_bounds"]
            return [Span(i, a, b) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > first and a < last]
        return [Span(a // self.size, max(a, first), min(a + self.size, last)) for a in range(first // self.size * self.size, last, self.size)]

    def matrix(self, span: Span) -> np.ndarray:
        with self._open() as f:
            if self.chunks:
                at = self.chunks["chunk_offsets"]
                f.seek(at[span.block])
                self.read_bytes = at[span.block + 1] - at[span.block]
                raw = zlib.decompress(f.read(self.read_bytes))
                order = "F" if self.chunks.get("chunk_order") == "F" else "C"
                made = np.frombuffer(raw, self.dtype).reshape((span.last - span.first, self.channels), order=order)
                made = np.cumsum(made, 0, dtype=self.dtype) if self.chunks.get("do_time_diff") else made
                return np.cumsum(made, 1, dtype=self.dtype) if self.chunks.get("do_spatial_diff") else made
            width = self.channels * self.dtype.itemsize
            f.seek(self.offset + span.first * width)
            self.read_bytes = (span.last - span.first) * width
            return np.frombuffer(f.read(self.read_bytes), self.dtype).reshape(-1, self.channels)

    def rows(self, span: Span) -> Iterator[pa.RecordBatch]:
        data, first = self.matrix(span), span.first
        if self.chunks:  # a chunk is read whole
            a, b = max(span.first, self.first), span.last if self.last is None else min(span.last, self.last)
            data, first = data[a - span.first : b - span.first], a
        which = np.array([c for c in (range(self.channels) if self.only is None else self.only) if c < self.channels and self.wanted("channel", c)], int)
        data = data.T[which].astype(np.float32) * np.float32(self.scale)
        n = len(data)
        values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * data.shape[1], pa.int32()), pa.array(np.ascontiguousarray(data).ravel()))
        columns = {"block": pa.array(np.full(n, span.block)), "channel": pa.array(which), "first_sample": pa.array(np.full(n, first)), "samples": values}
        if self.counted:
            columns["read_bytes"] = pa.array(np.full(n, self.read_bytes))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def wanted(self, column: str, value: int) -> bool:
        """Whether a row may have this value under the filters that the source has taken over."""
        return all(test(value) for c, test in self.tests if c == column)


def _channels(text: str) -> list[int]:
    """Channels of ``0:3,7``: runs with both ends, and single ones."""
    ends = [[int(x) for x in part.split(":")] for part in text.split(",") if part]
    return [c for e in ends for c in range(e[0], e[-1] + 1)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.file = _File(options)

    def partitions(self) -> list[Span]:
        """Spans with any row that is asked for; a row's first sample is its span's, or the option ``first`` within it."""
        some = any(self.file.wanted("channel", c) for c in (range(self.file.channels) if self.file.only is None else self.file.only))
        spans = self.file.spans(0, self.file.length()) if some else []
        return [s for s in spans if self.file.wanted("block", s.block) and self.file.wanted("first_sample", max(s.first, self.file.first))] or [Span(0, 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.file.rows(partition) if partition.last > partition.first else iter(())


class _PushReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes over comparisons of block, first_sample and channel; Spark sees to the rest."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in ("block", "first_sample", "channel"):
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                self.file.tests.append((column, _Test(type(f), f.value)))
            elif isinstance(f, In):
                self.file.tests.append((column, _Test(In, frozenset(f.value) - {None})))
            elif not isinstance(f, IsNotNull):  # none of them is ever null
                yield f


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of samples; a growing file gives what was added, in whole samples."""

    def __init__(self, options: dict):
        self.file = _File(options)

    def initialOffset(self) -> dict:
        return {"samples": 0}

    def latestOffset(self) -> dict:
        return {"samples": self.file.length()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return self.file.spans(start["samples"], end["samples"])

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.file.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class RecordingSource(DataSource):
    """Options: path, channels, dtype, block (samples of a row), scale (volts per bit), first, last, only, push (true: filters are taken over), read_bytes (true: a column with the bytes read for a row's partition)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return SCHEMA + (", read_bytes bigint" if self.options.get("read_bytes", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return (_PushReader if self.options.get("push", "false").lower() == "true" else _Reader)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def pushed(spark, path: str, where: str, **options) -> DataFrame:
    """A recording's rows under a condition that reaches the source, in a load of its own."""
    spark.dataSource.register(RecordingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # concerns loads with ``push`` alone
    return spark.read.format("recording").options(push="true", **{k: str(v) for k, v in options.items()}).load(path).where(where)


def read_recording(spark, path: str, meta: str | None = None, band: str | None = None, **options) -> DataFrame:
    """A recording with the metadata beside it: block, channel, first_sample, samples in volts, shank, x, y, position.

    The ``.meta`` file of the same name (or ``meta``) tells the number of
    channels, each one's gain and its site; sync traces have no site and stay
    as they are.  ``options`` are those of the source.
    """
    from pyspark.sql import functions as F

    from . import metadata as M

    told = M.read(spark, meta or path.rsplit(".", 1)[0] + ".meta")
    facts = told.select(M.number(F.col("meta"), "nSavedChans").cast("long").alias("n"), M.band(F.col("meta")).alias("band")).first()
    spark.dataSource.register(RecordingSource)
    reader = spark.read.format("recording")
    for k, v in ({"channels": facts.n} | options).items():
        reader = reader.option(k, v)
    gains = M.volts_per_bit(told).select("channel", F.coalesce(F.col(band or facts.band or "ap"), F.lit(1.0)).alias("gain"))
    sites = M.geometry(told).select(F.col("ind").cast("long").alias("channel"), "shank", "x", "y", "position")
    rows = reader.load(path).join(gains, "channel").join(sites, "channel", "left")
    volts = F.transform("samples", lambda v: v.cast("double") * F.col("gain"))
    return rows.select("block", "channel", "first_sample", volts.alias("samples"), "shank", "x", "y", "position")


def between(df: DataFrame, first: int, last: int) -> DataFrame:
    """The samples [first, last) of array rows (first_sample, samples): rows cut to what is asked, others left out."""
    from pyspark.sql import functions as F

    begin = F.greatest(F.lit(first) - F.col("first_sample"), F.lit(0)).cast("int")
    end = F.least(F.lit(last) - F.col("first_sample"), F.size("samples")).cast("int")
    rows = df.where((F.col("first_sample") < last) & (F.col("first_sample") + F.size("samples") > first))
    return rows.withColumns({"samples": F.slice("samples", begin + 1, end - begin), "first_sample": F.col("first_sample") + begin})


def sync_words(df: DataFrame, channel: int) -> DataFrame:
    """The digital words of a sync trace: sample, word."""
    from pyspark.sql import functions as F

    one = df.where(F.col("channel") == channel).select("first_sample", F.posexplode("samples").alias("i", "v"))
    return one.select((F.col("first_sample") + F.col("i")).alias("sample"), F.pmod(F.col("v").cast("long"), F.lit(65536)).alias("word"))


def write_compressed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as zstd Parquet, the recording's compressed form."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def pad_tail(df: DataFrame, samples: int) -> DataFrame:
    """Rows with the recording's last sample repeated ``samples`` times at the end of each channel."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    last = F.col("first_sample") == F.max("first_sample").over(Window.partitionBy("channel"))
    more = F.concat("samples", F.array_repeat(F.element_at("samples", -1), samples))
    return df.withColumn("__last", last).withColumn("samples", F.when(F.col("__last"), more).otherwise(F.col("samples"))).drop("__last")


def probe_files(spark, root: str) -> DataFrame:
    """A row per probe of a folder tree: folder, label, and paths of its ap, lf and nidq files."""
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*bin").load(root).select("path")
    kind = F.regexp_extract("path", r"\.(ap|lf|nidq)\.[^/]*bin$", 1)
    label = F.coalesce(F.nullif(F.regexp_extract("path", r"\.(imec\d*|probe\d+)\.", 1), F.lit("")), F.lit(""))
    found = files.select("path", kind.alias("kind"), label.alias("label"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).where("kind <> ''")
    return found.groupBy("folder", "label").pivot("kind", ["ap", "lf", "nidq"]).agg(F.first("path"))


def with_system(files: DataFrame) -> DataFrame:
    """Rows of :func:`probe_files` with ``system``: 3B where a board's file stands beside the probes', else 3A."""
    from pyspark.sql import functions as F

    boards = files.where("nidq IS NOT NULL").agg(F.count(F.lit(1)).alias("boards"))
    return files.crossJoin(boards).withColumn("system", F.when(F.col("boards") > 0, "3B").otherwise("3A")).drop("boards")


def mock_recording(path: str, channels: int, samples: int, volts_per_bit: float) -> None:
    """A file whose channel c holds (c + 1) over the scale, its first 16 rows zero, its last channel walking bits."""
    data = np.tile(np.round((np.arange(channels) + 1) / volts_per_bit / 1e6), (samples, 1)).astype(np.int16)
    data[:16] = 0
    data[:, -1] = 1 << (np.arange(samples) % 15)
    data.tofile(path)
