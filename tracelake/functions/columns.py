"""Column functions: tapers, windows, array extrema with the first-of-ties rule."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_ramp(x: Column, low: float, high: float) -> Column:
    """0 up to ``low``, 1 from ``high``, half a cosine between."""
    mid = (1 - F.cos((x - low) / (high - low) * math.pi)) / 2
    return F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise(mid)


def taper(x: Column, first: float, last: float, n: int) -> Column:
    """Cosine taper of ``n`` samples at both ends of [first, last]."""
    return cosine_ramp(x, first, first + n) * (1 - cosine_ramp(x, last - n, last))


def ricker(points: Column, a: Column) -> Column:
    """Mexican-hat vector of ``points`` values and width ``a``."""
    scale = 2 / (F.sqrt(3 * a) * math.pi**0.25)
    t = lambda i: i - (points - 1) / 2
    return F.transform(F.sequence(F.lit(0), points - 1), lambda i: scale * (1 - (t(i) / a) * (t(i) / a)) * F.exp(-(t(i) * t(i)) / (2 * a * a)))


def hann(n: int) -> list[float]:
    """Symmetric Hann window with zero ends."""
    return [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)] if n > 1 else [1.0]


def without_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def first_argmax(values: Column) -> Column:
    """Index (from 0) of the greatest element, the first of equals; null and NaN are passed over."""
    best = F.aggregate(
        F.transform(values, lambda v, i: F.struct(F.when(~F.isnan(v), v).alias("v"), (-i).alias("i"))),
        F.struct(F.lit(None).cast("double").alias("v"), F.lit(0).alias("i")),
        lambda a, x: F.when(x["v"].isNotNull() & (a["v"].isNull() | (x["v"] > a["v"])), x).otherwise(a),
    )
    return -best["i"]


def at(array: Column, i: Column) -> Column:
    """Element ``i`` (from 0), null outside."""
    return F.get(array, i.cast("int"))


def bits(x: Column, n: int = 16) -> Column:
    """The ``n`` lowest bits, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftright", x, i).bitwiseAND(F.lit(1)).cast("tinyint"))


def next_fast_length(n: Column) -> Column:
    """Least 2**p * 3**q (p < 25, q < 15) that is ``n`` or more."""
    sizes = sorted({2**p * 3**q for p in range(25) for q in range(15)})
    return F.array_min(F.filter(F.array(*(F.lit(s) for s in sizes if s < 1 << 40)), lambda s: s >= n))


def frequencies(n: Column, step: Column) -> Column:
    """One-sided frequency axis of ``n`` samples at interval ``step``, positive at Nyquist."""
    return F.transform(F.sequence(F.lit(0), F.floor(n / 2)), lambda k: k / n / step)
