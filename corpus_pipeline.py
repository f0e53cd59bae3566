"""Corpus pipeline: quality, exact and near duplicates, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns the columns of ``documents`` (the last: token ids).  In every
stage a null text counts as empty, extra columns of any name stay as they are,
and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, mixing, ngram_join, pieces_bpe, quality
from tracelake.llm.shared import shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and short texts go.

    Each row is judged by itself, so repeated rows and ids share a verdict.
    """
    judged = quality.cascade(docs.withColumnRenamed("kept", "__had_kept"))
    return judged.where("kept").drop("kept").withColumnRenamed("__had_kept", "kept")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id, once; a null id is less than any other.

    Rows with one id and different texts are different documents.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts, the document with the least id; what is linked with nothing stays.

    Rows with one id stay or go together: they stay if any of them does.  A
    null id is never the least unless alone.
    """
    return ngram_join.keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times; a null source is a source.

    Which ones depends on a hash of their ids, so rows with one id go together.
    """
    return mixing.take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document taken: ids with begin and end, their number, and the SHA-256 of what they decode to.

    Each row is encoded by itself; an empty text has begin and end alone.
    """
    import public_tokenizers

    out = pieces_bpe.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("source_mix", source_mix),
    ("sentencepiece", token_ids),
]

#: SQL has neither the vocabulary's merges nor its decoding; tests/llm/test_pipeline.py compares each stage's rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
