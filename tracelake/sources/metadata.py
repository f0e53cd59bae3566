"""Acquisition metadata (key=value text) and wiring descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.geometry import GRIDS, converter

_NUMBER = r"^[0-9,.]+$"


def parse(lines: DataFrame, column: str = "value", by: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per file: ``meta``, a map from key (without a leading tilde) to text."""
    pair = F.split(F.col(column), "=", 2)
    rows = lines.where(F.size(pair) == 2).select(*by, F.regexp_replace(pair[0], "^~", "").alias("k"), pair[1].alias("v"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("meta"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of all files under ``path``."""
    return parse(spark.read.text(path).withColumn("path", F.col("_metadata.file_path")))


def numbers(value: Column) -> Column:
    """Array of the numbers in a value of digits, commas and points; null for any other text."""
    parts = F.split(value, ",")
    plain = value.rlike(_NUMBER) & ~F.exists(parts, lambda x: x.rlike(r"\..*\.") | (x == ""))
    return F.when(plain, F.transform(parts, lambda x: x.cast("double")))


def number(meta: Column, key: str) -> Column:
    return F.get(numbers(F.try_element_at(meta, F.lit(key))), F.lit(0))


def text(meta: Column, key: str) -> Column:
    return F.try_element_at(meta, F.lit(key))


def serial(meta: Column) -> Column:
    return F.coalesce(number(meta, "imProbeSN"), number(meta, "imDatPrb_sn")).cast("long")


def version(meta: Column) -> Column:
    """Probe version by the keys that are there and the probe's type code."""
    kind = number(meta, "imDatPrb_type").cast("int")
    coded = F.when(kind.isin(21, 2003), "NP2.1").when(kind.isin(24, 2013), "NP2.4").when(kind == 1100, "NPultra").when(kind == 2020, "NP2QB").when(kind == 1030, "NHPlong")
    old = F.when(text(meta, "typeEnabled").isNotNull(), "3A")
    # ports and slots are named from version 3B2 on
    new = F.when(kind == 0, F.when(text(meta, "imDatPrb_port").isNotNull() & text(meta, "imDatPrb_slot").isNotNull(), "3B2").otherwise("3B1")).when(text(meta, "typeThis") == "nidq", "nidq")
    return F.coalesce(old, new, coded)


def major_version(v: Column) -> Column:
    return F.when(v.isin("3A", "3B1", "3B2"), "1").when(v.isin("NP2.1", "NP2.4"), "2").when(v.isin("NPultra", "NP2QB", "NHPlong"), v)


def max_int(meta: Column) -> Column:
    two = major_version(version(meta)).isin("2", "NP2QB")
    return F.when(two, number(meta, "imMaxInt")).otherwise(F.coalesce(number(meta, "imMaxInt"), F.when(text(meta, "typeThis") == "nidq", 32768.0).otherwise(512.0)))


def band(meta: Column) -> Column:
    """ap, lf or nidq, by the kinds of channels that are saved."""
    counts = numbers(text(meta, "snsApLfSy"))
    return F.when(text(meta, "typeThis") == "nidq", "nidq").when(F.get(counts, F.lit(0)) > 0, "ap").when(F.get(counts, F.lit(1)) > 0, "lf")


def rate(meta: Column) -> Column:
    return F.coalesce(number(meta, "imSampRate"), number(meta, "niSampRate"))


def sync_channels(meta: Column) -> Column:
    """Indices of the digital sync traces: the last of those saved."""
    n = number(meta, "nSavedChans").cast("long")
    counts = numbers(F.coalesce(text(meta, "snsApLfSy"), text(meta, "snsMnMaXaDw")))
    k = F.element_at(counts, -1).cast("long")
    return F.when(k > 0, F.sequence(n - k, n - 1)).otherwise(F.array().cast("array<bigint>"))


def analog_sync_channels(meta: Column) -> Column:
    """Indices of the auxiliary board's analog sync traces: those before the digital ones."""
    counts = numbers(text(meta, "snsMnMaXaDw"))
    first = (F.get(counts, F.lit(0)) + F.get(counts, F.lit(1))).cast("long")
    k = F.get(counts, F.lit(2)).cast("long")
    return F.when(k > 0, F.sequence(first, first + k - 1)).otherwise(F.array().cast("array<bigint>"))


def shank_count(meta: Column) -> Column:
    """Shanks of the probe by its version."""
    return F.when(version(meta).isin("NP2.4", "NP2QB"), F.lit(4)).when(text(meta, "typeThis") == "imec", F.lit(1)).cast("long")


def samples(meta: Column) -> Column:
    return F.round(number(meta, "fileTimeSecs") * rate(meta)).cast("long")


def sites(df: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """A row for each site of the shank or geometry map: place, shank, a, b, flag, micrometres.

    a and b are column and row of a shank map, x and y of a geometry map.
    """
    shank = text(F.col("meta"), "snsShankMap")
    geom = F.when(shank.isNull(), text(F.col("meta"), "snsGeomMap"))
    raw = F.coalesce(geom, shank)
    found = F.regexp_extract_all(raw, F.lit(r"\((\d+:\d+:\d+:\d+)\)"), 1)
    parts = F.split("t", ":")
    out = df.select(*by, geom.isNotNull().alias("micrometres"), F.posexplode(found).alias("place", "t"))
    return out.select(*by, "place", *(parts[i].cast("long").alias(n) for i, n in enumerate(("shank", "a", "b", "flag"))), "micrometres")


def geometry(df: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """A row for each site of the recording's map: ind, shank, row, col, flag, x, y, adc, sample_shift and position in probe order.

    Maps in micrometres count from the tip (20 below the first row) and, for
    version 1, from the other side; maps of columns and rows give version 1's
    columns in that order too.  The probe order is by shank, row and
    descending column.  A file without a map has no rows here; its layout is
    the dense one of its version.
    """
    v = F.coalesce(major_version(version(F.col("meta"))), F.lit("1"))
    rows = sites(df.select(*by, "meta"), by).join(df.select(*by, v.alias("v"), text(F.col("meta"), "NP2.4_shank").cast("long").alias("only")), list(by))
    a, b, um, one = F.col("a").cast("double"), F.col("b").cast("double"), F.col("micrometres"), F.col("v") == "1"
    grid = lambda k: F.element_at(F.create_map(*(F.lit(t) for name, g in GRIDS.items() for t in (name, g[k]))), F.col("v"))
    col = F.when(F.col("v").isin("1", "NHPlong"), 2 - 2 * a + F.pmod(b, F.lit(2.0))).otherwise(a)
    x = F.when(um, F.when(one, 70 - a).otherwise(a)).otherwise(col * grid(0) + grid(1))
    y = F.when(um, b + 20).otherwise(b * grid(2) + grid(3))
    rows = rows.select(*by, "place", "shank", "flag", "only", "v", x.alias("x"), y.alias("y"))
    adc1, shift1 = converter(F.col("place"), "1")
    adc2, shift2 = converter(F.col("place"), "2")
    two = F.col("v").isin("2", "NP2QB")
    rows = rows.withColumns({"row": (F.col("y") - grid(3)) / grid(2), "col": (F.col("x") - grid(1)) / grid(0), "adc": F.when(two, adc2).otherwise(adc1), "sample_shift": F.when(two, shift2).otherwise(shift1)})
    rows = rows.where("only IS NULL OR shank = only").withColumn("ind", F.row_number().over(Window.partitionBy(*by).orderBy("place")) - 1)
    order = Window.partitionBy(*by).orderBy("shank", "row", F.desc("col"))
    return rows.select(*by, "ind", "shank", "row", "col", "flag", "x", "y", "adc", "sample_shift", (F.row_number().over(order) - 1).alias("position"))


def volts_per_bit(df: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """A row for each saved channel: channel, ap and lf volts per bit (probes), nidq (auxiliary boards).

    Version 1 has its gains in the readout table; version 2 one gain for all:
    the one named, or 80 for parts NP2000 and NP2010, or 100.  Boards have the
    gains of multiplexed lines and of auxiliary ones, 1 for analog sync.
    Digital sync has no unit: 1.
    """
    meta = F.col("meta")
    board = text(meta, "typeThis") == "nidq"
    step = F.when(board, number(meta, "niAiRangeMax")).otherwise(number(meta, "imAiRangeMax")) / max_int(meta)
    found = F.regexp_extract_all(F.coalesce(text(meta, "imroTbl"), F.lit("")), F.lit(r"\(([0-9]+ [0-9 ]+)\)"), 1)
    two = version(meta).startswith("NP2")
    fixed = F.coalesce(number(meta, "imChan0apGain"), F.when(text(meta, "imDatPrb_pn").isin("NP2010", "NP2000"), 80.0).otherwise(100.0))
    runs = numbers(text(meta, "snsMnMaXaDw"))
    sync = F.size(sync_channels(meta))
    channel = F.explode(F.sequence(F.lit(0).cast("long"), number(meta, "nSavedChans").cast("long") - 1)).alias("channel")
    rows = df.select(*by, step.alias("step"), board.alias("board"), two.alias("two"), fixed.alias("fixed"), runs.alias("runs"), found.alias("found"), (number(meta, "nSavedChans") - sync).cast("long").alias("probe"), number(meta, "niMNGain").alias("mn"), number(meta, "niMAGain").alias("ma"), channel)
    parts = F.split(F.get("found", F.col("channel").cast("int")), " ")
    gain = lambda k: F.when(F.col("two"), F.col("fixed")).otherwise(F.get(parts, F.lit(k)).cast("double"))
    digital = F.col("channel") >= F.col("probe")
    probe = lambda k: F.when(~F.col("board"), F.when(digital, 1.0).otherwise(F.col("step") / gain(k)))
    first = F.get("runs", F.lit(0))
    second = first + F.get("runs", F.lit(1))
    line = F.when(F.col("channel") < first, F.col("step") / F.col("mn")).when(F.col("channel") < second, F.col("step") / F.col("ma")).when(F.col("channel") < second + F.get("runs", F.lit(2)), F.col("step")).otherwise(1.0)
    return rows.select(*by, "channel", probe(3).alias("ap"), probe(4).alias("lf"), F.when(F.col("board"), line).alias("nidq"))


def lines(df: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """key=value text of metadata rows, a row for each key in ascending order."""
    return df.select(*by, F.explode(F.array_sort(F.map_entries("meta"))).alias("e")).select(*by, F.concat_ws("=", "e.key", "e.value").alias("value"))


def write(df: DataFrame, path: str, by: tuple[str, ...] = ("path",)) -> None:
    """Metadata rows as key=value text: a folder for each row's key, in it one file."""
    told = df.select(*by, F.array_join(F.transform(F.array_sort(F.map_entries("meta")), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n").alias("value"))
    told.repartition(*by).write.mode("overwrite").partitionBy(*by).text(path)


def as_runs(channels: list[int]) -> str:
    """Channels in the form of a subset: ``0:3,7``."""
    runs: list[list[int]] = []
    for c in sorted(channels):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return ",".join(f"{a}:{b}" if b > a else str(a) for a, b in runs)


def for_part(meta: dict[str, str], channels: list[int], n_sync: int, band: str, shank: int, size: int, fs: float, split: bool) -> dict[str, str]:
    """Metadata of a part of a recording: the saved ``channels`` (``n_sync`` of them sync) of one shank and band, in a file of ``size`` bytes.

    A part of a split recording names its channels from 0, and those that it
    has of the original; what is marked as no original isn't converted again.
    """
    counts = [str(len(channels) - n_sync), "0"]
    told = ",".join([*(counts if band == "ap" else counts[::-1]), str(n_sync)])
    out = meta | {"acqApLfSy": told, "snsApLfSy": told, "fileSizeBytes": str(size), "imSampRate": f"{fs:g}", "original_meta": "False"}
    if split:
        return out | {"snsSaveChanSubset_orig": as_runs(channels), "snsSaveChanSubset": f"0:{len(channels) - 1}", "nSavedChans": str(len(channels)), "NP2.4_shank": str(shank)}
    return out | {f"{SINGLE}_shank": str(shank)}


#: Version that a probe with one shank is converted as.
SINGLE = "NP2.1"


def for_shanks(df: DataFrame, shanks: DataFrame) -> DataFrame:
    """Metadata (meta) of each shank's parts of a recording: shank, band, meta.

    ``shanks``: to_shank, n (saved channels, sync included), n_sync.  Counts of
    saved channels are those of the part, the low band's rate is a twelfth.
    """
    rows = df.select("meta").crossJoin(shanks).withColumn("band", F.explode(F.array(F.lit("ap"), F.lit("lf"))))
    sites = (F.col("n") - F.col("n_sync")).cast("string")
    sync = F.col("n_sync").cast("string")
    counts = F.when(F.col("band") == "ap", F.concat_ws(",", sites, F.lit("0"), sync)).otherwise(F.concat_ws(",", F.lit("0"), sites, sync))
    fs = F.when(F.col("band") == "lf", (rate(F.col("meta")) / 12).cast("string")).otherwise(text(F.col("meta"), "imSampRate"))
    new = F.create_map(F.lit("NP2.4_shank"), F.col("to_shank").cast("string"), F.lit("nSavedChans"), F.col("n").cast("string"), F.lit("snsApLfSy"), counts, F.lit("acqApLfSy"), counts, F.lit("imSampRate"), fs)
    old = F.map_filter("meta", lambda k, _: ~k.isin("NP2.4_shank", "nSavedChans", "snsApLfSy", "acqApLfSy", "imSampRate"))
    return rows.select(F.col("to_shank").cast("long").alias("shank"), "band", F.map_concat(old, new).alias("meta"))


def wiring(spark: SparkSession, path: str) -> DataFrame:
    """Wiring descriptions: system, digital and analog maps from pin to device."""
    raw = spark.read.text(path, wholetext=True)
    shape = "SYSTEM string, SYNC_WIRING_DIGITAL map<string,string>, SYNC_WIRING_ANALOG map<string,string>"
    one = raw.select(F.from_json("value", shape).alias("w"))
    return one.select(F.col("w.SYSTEM").alias("system"), F.col("w.SYNC_WIRING_DIGITAL").alias("digital"), F.col("w.SYNC_WIRING_ANALOG").alias("analog"))
