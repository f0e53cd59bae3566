"""Probe geometry and metadata projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import at

# fixed values: site grids in micrometres, by version
GRIDS = {"1": (16.0, 11.0, 20.0, 20.0), "2": (32.0, 27.0, 15.0, 20.0), "NPultra": (6.0, 0.0, 6.0, 0.0), "NP2QB": (32.0, 27.0, 15.0, 20.0), "NHPlong": (43.5, 27.0, 15.0, 20.0)}
# fixed values: volts per bit, channels, deprecated reference sites
VOLTS_AP, VOLTS_LF, CHANNELS = 2.34375e-06, 4.6875e-06, 384
REFERENCE_SITES = (36, 75, 112, 151, 188, 227, 264, 303, 340, 379)
# fixed values: sync pins that are wired, by system, in order of their channel
PINS_3A = ("pin01", "pin02", "pin03", "pin04", "pin06", "pin07", "pin08", "pin09", "pin11", "pin12", "pin13", "pin14", "pin16", "pin17", "pin18", "pin19")
PINS_3B = ("P0.0", "P0.1", "P0.2", "P0.3", "P0.4", "P0.5", "P0.6", "P0.7")


def _grid(version: str) -> tuple[float, float, float, float]:
    key = version.split(".")[0] if version[0].isdigit() else version
    if key not in GRIDS:
        raise ValueError(f"unknown probe version {version}")
    return GRIDS[key]


def to_um(row: Column, col: Column, version: str = "1") -> tuple[Column, Column]:
    """x and y in micrometres of grid indices."""
    dx, x0, dy, y0 = _grid(version)
    return col * dx + x0, row * dy + y0


def to_grid(x: Column, y: Column, version: str = "1") -> tuple[Column, Column]:
    """Row and column of micrometres."""
    dx, x0, dy, y0 = _grid(version)
    return (y - y0) / dy, (x - x0) / dx


def layout(spark: SparkSession, version: str = "1", shanks: int = 1, channels: int = CHANNELS) -> DataFrame:
    """Dense layout: ind, row, col, shank, x, y."""
    quad = version == "NP2QB"
    _grid(version)
    sites = spark.range(CHANNELS * 4 if quad else channels).withColumnRenamed("id", "ind")
    i = F.pmod("ind", F.lit(CHANNELS)) if quad else F.col("ind")
    row, shank = F.floor(i / 2), (F.floor(F.col("ind") / CHANNELS) if quad else F.lit(0))
    if version in ("1", "NHPlong"):
        col = at(F.array(*map(F.lit, (2, 0, 3, 1))), F.pmod(i, F.lit(4)))
    elif version == "NPultra":
        row, col = F.floor(i / 8), F.pmod(i, F.lit(8))
    else:
        col = F.pmod(i, F.lit(2))
        if shanks == 4 and not quad:
            # pairs of shanks take turns in banks of an eighth of the sites
            bank = F.floor(i / (channels // 8))
            shank = F.floor(bank / 4) * 2 + F.pmod(bank, F.lit(2))
            row = F.floor(F.pmod(i, F.lit(channels // 8)) / 2) + F.pmod(F.floor(bank / 2), F.lit(2)) * (channels // 16)
    out = sites.select("ind", row.cast("double").alias("row"), col.cast("double").alias("col"), shank.cast("double").alias("shank"))
    x, y = to_um(F.col("row"), F.col("col"), version)
    return out.withColumn("x", x).withColumn("y", y)


def converter(ind: Column, version: str = "1") -> tuple[Column, Column]:
    """Converter of a channel, and its delay as a part of the sample."""
    size, cycles = (12, 13) if version in ("1", "NPultra", "NHPlong") else (16, 16)
    adc = F.floor(ind / (size * 2)) * 2 + F.pmod(ind, F.lit(2))
    return adc.cast("double"), F.floor(F.pmod(ind, F.lit(size * 2)) / 2) / cycles


def trace_header(spark: SparkSession, version: str = "1", shanks: int = 1) -> DataFrame:
    """Layout with converter and sample shift of each channel."""
    adc, shift = converter(F.col("ind"), version)
    return layout(spark, version, shanks).withColumn("adc", adc).withColumn("sample_shift", shift)


def legacy_sites(spark: SparkSession) -> DataFrame:
    """Sites of version 1 without its reference sites."""
    refs = spark.createDataFrame([(x,) for x in REFERENCE_SITES], "ind long")
    return layout(spark).join(F.broadcast(refs), "ind", "left_anti")


def split_shanks(geometry: DataFrame, shank: int) -> DataFrame:
    return geometry.where(F.col("shank") == shank)


def sorted_geometry(geometry: DataFrame) -> DataFrame:
    """``geometry`` with its order by shank, row and descending column."""
    return geometry.withColumn("position", (F.row_number().over(Window.orderBy("shank", "row", F.desc("col"))) - 1).cast("long"))


def neighbours(geometry: DataFrame, radius: float = 200.0) -> DataFrame:
    """channel, slot, neighbour: the sites within ``radius`` of each, itself included, ascending.

    Sites fall into cells of the radius' height, and only cells side by side
    are compared: an equality join, however many sites there are.
    """
    near = geometry.select("ind", "x", "y", F.floor(F.col("y") / radius).alias("cell"))
    other = near.select(F.col("ind").alias("neighbour"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
    pairs = near.join(other, "cell").where(dx * dx + dy * dy <= radius * radius)
    w = Window.partitionBy("ind").orderBy("neighbour")
    return pairs.select(F.col("ind").alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("slot"), "neighbour")


def padded_neighbours(edges: DataFrame, channels: int) -> DataFrame:
    """channel, neighbours: arrays of one length, padded with ``channels``."""
    lists = edges.groupBy("channel").agg(F.array_sort(F.collect_list("neighbour")).alias("neighbours"))
    widest = edges.agg(F.max("slot").alias("widest"))
    return lists.join(F.broadcast(widest)).select("channel", F.concat("neighbours", F.array_repeat(F.lit(channels).cast("long"), (F.col("widest") + 1 - F.size("neighbours")).cast("int"))).alias("neighbours"))


def ranges_text(channels: DataFrame, column: str = "channel") -> DataFrame:
    """One row: the channels as text of runs, ``0:10,50:90,384`` (a lone channel before the last as ``5:5``)."""
    runs = channels.select(F.col(column).alias("c")).withColumn("run", F.col("c") - F.row_number().over(Window.orderBy("c")))
    ends = runs.groupBy("run").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    top = F.max("b").over(Window.partitionBy(F.lit(0)))
    told = F.when((F.col("a") == F.col("b")) & (F.col("b") == top), F.col("a").cast("string")).otherwise(F.concat_ws(":", "a", "b"))
    listed = ends.select("a", told.alias("t"))
    return listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "t"))), lambda x: x["t"]), ",").alias("subset"))


def ranges_expanded(texts: DataFrame, column: str = "subset") -> DataFrame:
    """Inverse of :func:`ranges_text`: a row for each channel."""
    part = F.explode(F.split(column, ","))
    ends = F.split("part", ":")
    return texts.select(part.alias("part")).select(F.explode(F.sequence(F.element_at(ends, 1).cast("long"), F.element_at(ends, -1).cast("long"))).alias("channel"))


def sync_map(wiring: DataFrame) -> DataFrame:
    """device, channel: of wiring rows (system, digital, analog: maps from pin to device).

    Pins of the systems 3A and 3B have fixed channels, other pins that of
    their number; analog pin n is channel 16 + n.
    """
    pins = F.create_map(*(F.lit(x) for i, p in enumerate(PINS_3A) for x in (p, i)), *(F.lit(x) for i, p in enumerate(PINS_3B) for x in (p, i)))
    number = F.regexp_extract("pin", r"(\d+)$", 1).cast("int")
    known = F.element_at(pins, F.col("pin"))
    digital = wiring.select("system", F.explode("digital").alias("pin", "device")).where("device <> ''")
    digital = digital.select("device", F.when(F.col("system").isin("3A", "3B"), known).otherwise(number).cast("long").alias("channel"))
    analog = wiring.select(F.explode("analog").alias("pin", "device")).where("device <> ''").select("device", (number + 16).cast("long").alias("channel"))
    return digital.unionByName(analog)
