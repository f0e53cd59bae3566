"""Functions for SQL texts: kernels as Arrow-batched functions, and table functions.

Those with a table argument are polymorphic: what they return follows the
table's own columns, and ``PARTITION BY`` deals its groups over the tasks, as in
``SELECT * FROM signal_destripe(TABLE(rows) PARTITION BY block, fs => 30000D)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import kernels as K


def _each(samples: pd.Series, made) -> pd.Series:
    return pd.Series([made(np.asarray(x, float), k) for k, x in enumerate(samples)], index=samples.index)


@pandas_udf(ArrayType(DoubleType()))
def delay(samples: pd.Series, by: pd.Series) -> pd.Series:
    """Samples delayed by parts of a sample."""
    return _each(samples, lambda x, k: K.shift(x, by.iloc[k]))


@pandas_udf(ArrayType(DoubleType()))
def high_pass(samples: pd.Series, fs: pd.Series, corner: pd.Series) -> pd.Series:
    """Zero-phase Butterworth high-pass of order 3."""
    return _each(samples, lambda x, k: K.sosfiltfilt(K.butterworth(3, 2 * corner.iloc[k] / fs.iloc[k], "highpass"), x))


@pandas_udf(DoubleType())
def root_mean_square(v: pd.Series) -> float:
    """RMS of a group's values."""
    return float(np.sqrt((v.astype(float) ** 2).mean()))


@udtf(returnType=StructType([StructField(n, LongType()) for n in ("iw", "first", "last")]))
class Windows:
    """Windows of ``size`` samples that overlap, over ``ns`` samples."""

    def eval(self, ns: int, size: int, overlap: int) -> Iterator[tuple[int, int, int]]:
        step = size - overlap
        for k in range(max(1, -(-(ns - size) // step) + 1)):
            yield k, k * step, min(k * step + size, ns)


def _columns(table: AnalyzeArgument, *needed: str) -> StructType:
    if not table.isTable:
        raise ValueError("the first argument has to be a table: TABLE(rows)")
    missing = [c for c in needed if c not in table.dataType.names]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return table.dataType


def _with(shape: StructType, **kinds) -> StructType:
    """The shape with these columns of other types, new ones last."""
    own = [StructField(f.name, kinds.pop(f.name, f.dataType)) for f in shape]
    return StructType(own + [StructField(k, v) for k, v in kinds.items()])


class _Group:
    """Gathers the rows of one partition of a table argument; :meth:`made` gives its result."""

    def __init__(self):
        self.rows: list[Row] = []
        self.options: tuple = ()

    def eval(self, table: Row, *options, **named):
        self.rows.append(table)
        self.options = (options, named)

    def terminate(self):
        if self.rows:
            yield from self.made(*self.options[0], **self.options[1])

    def column(self, name: str, default=None) -> np.ndarray:
        there = name in self.rows[0].asDict()
        return np.array([r[name] if there and r[name] is not None else default for r in self.rows])

    def matrix(self) -> np.ndarray:
        self.rows.sort(key=lambda r: r["channel"])
        return np.stack([np.asarray(r["samples"], float) for r in self.rows])


class Destripe(_Group):
    """Rows (channel, samples; if there are any: shank, sample_shift, x, y, label) of one block, cleaned: all columns as they are but samples.

    ``fs``, and by name ``corner`` of the high-pass and ``k_filter`` (true: the
    k-filter, false: the common reference).
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, fs: AnalyzeArgument, corner: AnalyzeArgument | None = None, k_filter: AnalyzeArgument | None = None) -> AnalyzeResult:
        return AnalyzeResult(_with(_columns(table, "channel", "samples"), samples=ArrayType(DoubleType())))

    def made(self, fs, corner=300, k_filter=True):
        from ..operators import voltage as V

        x, names = self.matrix(), self.rows[0].asDict()
        shift = self.column("sample_shift", 0.0).astype(float) if "sample_shift" in names else None
        xy = tuple(self.column(c).astype(float) for c in ("x", "y")) if {"x", "y"} <= set(names) else None
        sos = K.butterworth(3, 2 * float(corner) / float(fs), "highpass")
        out = V.clean_block(x, float(fs), self.column("shank", 0), shift, xy, self.column("label", 0).astype(int), sos, V.spatial_kernel(float(fs), bool(k_filter)))
        for row, y in zip(self.rows, out, strict=True):
            yield tuple(y.tolist() if c == "samples" else row[c] for c in names)


class BadChannels(_Group):
    """Rows (channel, samples) of one block without samples, with rms_raw, xcor_hf, xcor_lf, psd_hf and label."""

    @staticmethod
    def analyze(table: AnalyzeArgument, fs: AnalyzeArgument) -> AnalyzeResult:
        shape = _columns(table, "channel", "samples")
        kept = StructType([f for f in shape if f.name not in ("samples", "label")])
        return AnalyzeResult(_with(kept, rms_raw=DoubleType(), xcor_hf=DoubleType(), xcor_lf=DoubleType(), psd_hf=DoubleType(), label=LongType()))

    def made(self, fs):
        from ..operators import voltage as V

        found = V.channel_features(self.matrix(), float(fs))
        own = [c for c in self.rows[0].asDict() if c not in ("samples", "label")]
        for i, row in enumerate(self.rows):
            yield (*(row[c] for c in own), *(None if np.isnan(v[i]) else float(v[i]) for k, v in found.items() if k != "label"), int(found["label"][i]))


class Fronts:
    """Rows of a table, in the order that the call gives, where the column v changes by ``step`` or more, with ``polarity``.  One row is held."""

    def __init__(self):
        self.last = None

    @staticmethod
    def analyze(table: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_with(_columns(table, "v"), polarity=DoubleType()))

    def eval(self, table: Row, step):
        before, self.last = self.last, table["v"]
        if before is not None and self.last is not None and abs(self.last - before) >= step:
            yield (*table, float(self.last - before))


def register(spark: SparkSession) -> None:
    """Names for SQL: signal_delay, signal_high_pass, signal_rms, signal_windows; of tables: signal_destripe, signal_bad_channels, signal_fronts."""
    spark.udf.register("signal_delay", delay)
    spark.udf.register("signal_high_pass", high_pass)
    spark.udf.register("signal_rms", root_mean_square)
    spark.udtf.register("signal_windows", Windows)
    for name, made in (("destripe", Destripe), ("bad_channels", BadChannels), ("fronts", Fronts)):
        spark.udtf.register(f"signal_{name}", udtf(made))
