"""The driver's tables seen as recordings, waveforms, series and spikes; each with its SQL."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the shared ones; where none is named, a temporary one in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tracelake-")
    return f"{at}/{name}-{uuid.uuid4().hex}"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 100 channels on four shanks, 64 samples each: block, channel, shank, samples."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / 100).alias("block"),
        F.pmod("vec_id", F.lit(100)).alias("channel"),
        F.floor(F.pmod("vec_id", F.lit(100)) / 25).alias("shank"),
        F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )


def signal_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signal`` with a row per sample: block, channel, shank, label, sample, v."""
    return signal(spark, sf_dir).select("block", "channel", "shank", "label", F.posexplode("samples").alias("sample", "v")).withColumn("sample", F.col("sample").cast("long"))


SIGNAL = """sig AS (
  SELECT vec_id // 100 AS block, vec_id % 100 AS channel, (vec_id % 100) // 25 AS shank, label::BIGINT AS label,
         i - 1 AS sample, embedding[i]::DOUBLE AS v
  FROM embeddings, unnest(range(1, 65)) t(i))"""


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms of 16 samples on 4 traces: waveform_index, cluster, trace, samples."""
    e = table(spark, sf_dir, "embeddings")
    traces = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.get(F.col("embedding"), i * 4 + k).cast("double")))
    return e.select(F.col("vec_id").alias("waveform_index"), F.col("label").cast("long").alias("cluster"), traces.alias("traces"))


WAVES = """wave AS (
  SELECT vec_id AS waveform_index, label::BIGINT AS cluster, (i - 1) % 4 AS trace, (i - 1) // 4 AS t, embedding[i]::DOUBLE AS v
  FROM embeddings, unnest(range(1, 65)) x(i))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as one channel: channel, sample, v."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("channel"), (F.row_number().over(w) - 1).cast("long").alias("sample"), F.col("value").alias("v"))


SERIES = """series AS (
  SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample, value AS v
  FROM events)"""


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spikes: sample (one a second), cluster, channel, sorter, spike."""
    e = table(spark, sf_dir, "events")
    second = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - 1_704_067_200
    return e.select(second.alias("sample"), F.col("user_id").alias("cluster"), F.pmod("event_id", F.lit(100)).alias("channel"), F.col("event_type").alias("sorter"), F.col("event_id").alias("spike"))


SPIKES = """spikes AS (
  SELECT (epoch_us(ts) // 1000000) - 1704067200 AS sample, user_id AS cluster, event_id % 100 AS channel, event_type AS sorter, event_id AS spike
  FROM events)"""
