"""Helpers shared by the training-data operators: tables, shared folders, packed arrays."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
#: Bits of a key filter, as a power of two.
FILTER_BITS = 26
SPACES_RE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of sessions that name none, as in tests.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="tracelake-")
        at = _OWN["dir"]
    return at


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and its shuffle files go."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that steps have written for later steps, and what they broadcast, to be removed once nothing to come reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.shared = spark, [], []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As :func:`materialise`."""
        out, path = _written(df, name)
        self.paths.append(path)
        return out

    def broadcast(self, value):
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def clear(self) -> None:
        context = self.spark.sparkContext
        for held in self.shared:
            held.destroy()
        self.shared = []
        for path in self.paths:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        self.paths = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of some MB at most, however long the texts, for what runs in this session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def tidy() -> None:
    """Gives memory that is free in this Python worker back to the system; workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession, weight: float, each: float) -> int:
    """Shuffle partitions of about ``each`` of ``weight``, at least the session's own number."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(max(own, -(-weight // each)))


def dealt(df: DataFrame, count: int, *keys: str) -> DataFrame:
    """``df`` in ``count`` partitions by its keys where the session's own number is less: groups of a bounded size, and as many tasks as they ask for."""
    return df.repartition(count, *keys) if count > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def words_of(text: Column) -> Column:
    """Words of a text as an array; empty for a null text or one of white space alone."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES_RE))


def pieces(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of the first string column, one row at least."""
    kind = [i for i, f in enumerate(batch.schema) if pa.types.is_string(f.type) or pa.types.is_large_string(f.type)]
    if not kind or batch.num_rows == 0:
        yield batch
        return
    sizes = pc.binary_length(batch.column(kind[0])).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and the offsets of its rows in them; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    parts = column.buffers()
    offsets = np.frombuffer(parts[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _CACHE.get(base)
    if held is None or len(held) < n:
        held = _powers(base, max(n, 1 << 16))
        if len(held) <= 1 << 23:
            _CACHE[base] = held
    return held[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of many texts; ``space`` marks the bytes between words.  A word never crosses from one text into the next."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < n)]
    first[bounds] = inside[bounds]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[bounds - 1] = inside[bounds - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts.

    ``data`` holds the texts' bytes end to end and ``offsets`` their bounds.
    Returns the hashes, the first and end byte of each word, and for each text
    the index of its first word (one more entry at the end).  With ``lower``
    A-Z count as a-z.  Words are as in :func:`word_bounds`.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    start, end = word_bounds(data, offsets, space)
    # sum of value * base**-i over a word, times base**end: the same for equal words wherever they stand
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _BYTES)[data] * powers(_INVERSE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * powers(_ODD, n + 1)[end] + (end - start).astype(np.uint64))
    return hashes, start, end, np.searchsorted(start, offsets)


def pack(partition: np.ndarray, count: int, *columns: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows of equal-length ``columns`` gathered by partition, each column's bytes in turn."""
    if len(partition) == 0:
        return []
    order = np.argsort(partition, kind="stable")
    bounds = np.searchsorted(partition[order], np.arange(count + 1))
    columns = tuple(c[order] for c in columns)
    return [(int(p), b"".join(c[a:b].tobytes() for c in columns)) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]


def unpack(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    """Inverse of :func:`pack` over many blobs: one array for each column."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for i, k in enumerate(kinds):
            out[i].append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True)]


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of the hashes of the keys (one column of longs), in an array of a fixed size (8 MB)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[(mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        rows = [(i, zlib.compress(np.packbits(c).tobytes(), 1)) for i, c in enumerate(bits.reshape(64, -1)) if c.any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["chunk", "blob"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << FILTER_BITS - 9, np.uint8)
        for blob in group["blob"]:
            total |= np.frombuffer(zlib.decompress(blob), np.uint8)
        return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "blob": [zlib.compress(total.tobytes(), 1)]})

    out = np.zeros((64, 1 << FILTER_BITS - 9), np.uint8)
    marked = keys.mapInArrow(mark, "chunk int, blob binary").groupBy("chunk").applyInPandas(join, "chunk int, blob binary")
    for row in marked.collect():  # 8 MB at most
        out[row.chunk] = np.frombuffer(zlib.decompress(row.blob), np.uint8)
    return out.reshape(-1)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys a filter may hold: all that it was made of, and few others."""
    at = (mix(keys.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
