"""Exact deduplication as a stateful stream.

Documents stream through a keyed aggregation whose state is held on disk by
the RocksDB provider, without watermark or expiry: for each SHA-256 digest it
retains the stable identifier of the row that stays, a locator of that row's
content (file and row number) and the number of rows seen.  Map tasks combine
a digest's rows before the shuffle, so one large group of copies costs each
task one row.  A later run over new files of the same folder goes on from the
checkpoint.

Hits (digests seen twice or more) are then checked by all their bytes.  A
second scan writes each row's digest and place, with its content if the digest
is a hit.  The contents that the locators point at are taken from it, and each
task's distinct contents of the other hits are compared with them: a large
group of copies again costs each task one row.  Rows whose bytes differ
although their digests agree form groups of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, key_filter, materialise, passes, shared_path, tidy

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # many partitions with little state each: no space allotted ahead
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # a partition's store goes with its task; else all stay open in the executors while later steps run
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

#: Arrow batches of the scan, which holds a batch's contents several times over.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def sha256_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def place_of() -> Column:
    """A row's locator: its file and number there, as a long."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def digest_state(stream: DataFrame, id_col: str, text_col: str, digest=sha256_of) -> DataFrame:
    """Streaming aggregate: digest, keep (id and locator of the row with the largest id), n."""
    rows = stream.select(
        digest(F.col(text_col)).alias("digest"),
        F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    )
    return rows.groupBy("digest").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))


def run_stream(spark: SparkSession, path: str, schema, id_col: str, text_col: str, digest=sha256_of, at: str | None = None, bytes_per_trigger: int = 64 << 30) -> DataFrame:
    """Drains the files under ``path`` through the state; returns one row per digest: keep_id, keep_place, n.

    ``at`` is the folder of checkpoint and output; the same folder goes on
    from its state (files already seen are not read again).
    """
    at = at or shared_path(spark, "dedup")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    with _settings(spark, _STATE):
        # as a pattern, the path may name one file as well as a folder
        pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(pattern)
        query = (
            digest_state(stream, id_col, text_col, digest)
            .writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{at}/checkpoint")
            .foreachBatch(sink)
            .start()
        )
        query.awaitTermination()
    kind = schema[id_col].dataType.simpleString()
    shape = f"digest string, keep struct<id:{kind},file:string,row:bigint>, n bigint, batch bigint"
    try:
        found = spark.read.schema(shape).parquet(f"{at}/out")
    except Exception as e:  # an empty folder has no batch: no documents at all
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"digest string, keep_id {kind}, keep_place bigint, n bigint")
    # a digest's last batch holds its state
    last = found.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("s"))
    return last.select("digest", F.col("s.keep.id").alias("keep_id"), F.xxhash64("s.keep.file", "s.keep.row").alias("keep_place"), F.col("s.n").alias("n"))


def _scan(docs: DataFrame, hits: DataFrame, work: Scratch) -> DataFrame:
    """Rows (id, digest, body, place) without the bodies that are no hits', and ``stays``: what a locator may point at."""
    digests = work.broadcast(key_filter(hits.select(F.xxhash64("digest").alias("key"))))
    places = work.broadcast(key_filter(hits.select("keep_place")))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(passes(digests.value, batch.column("key").to_numpy()))
            body = pc.if_else(hit, batch.column("body"), pa.scalar(None, batch.schema.field("body").type))
            stays = pc.and_(hit, pa.array(passes(places.value, batch.column("place").to_numpy())))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), body, batch.column("place"), stays], names=["id", "digest", "body", "place", "stays"])
        tidy()

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("key", F.xxhash64("digest")).mapInArrow(pick, f"{shape}, stays boolean")


def _verdicts(spark: SparkSession, path: str, id_col: str, text_col: str, digest) -> DataFrame:
    """Per row of the table at ``path``: id, digest, place, keep_id, keep_place, n."""
    docs = spark.read.parquet(path)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), digest(F.col(f"`{text_col}`")).alias("digest"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"), place_of().alias("place"))
    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    work = Scratch(spark)
    state = materialise(run_stream(spark, path, docs.schema, id_col, text_col, digest), "dedup-state")
    hits = state.where("n > 1").select("digest", "keep_place")
    with _settings(spark, _BATCHES):
        scan = materialise(_scan(rows, hits, work), "dedup-scan")
    held = scan.where("body IS NOT NULL")
    kept = held.where("stays").join(hits, (held["digest"] == hits["digest"]) & (F.col("place") == F.col("keep_place"))).select(hits["digest"], F.col("body").alias("keep_body"))
    kept = work.write(kept, "dedup-kept")
    odd = held.select("digest", "body").distinct().join(kept, "digest").where("body <> keep_body").select("digest").distinct()
    odd = work.write(odd, "dedup-odd")
    whole = scan.select("id", "digest", "place").join(state, "digest")
    if odd.isEmpty():
        work.clear()
        return whole
    # digests that stand for several texts: group their rows by all bytes
    broken = materialise(odd, "dedup-broken")
    work.clear()
    several = held.join(broken, "digest", "left_semi")
    groups = several.groupBy("digest", "body").agg(F.max(F.struct("id", "place")).alias("keep"), F.count(F.lit(1)).alias("n"))
    split = several.join(groups, ["digest", "body"]).select("id", "digest", "place", F.col("keep.id").alias("keep_id"), F.col("keep.place").alias("keep_place"), "n")
    return whole.join(broken, "digest", "left_anti").unionByName(split)


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256_of) -> DataFrame:
    """For each row of the Parquet table at ``path``: id, digest, ``keep_id``, ``group_size``.

    Texts are equal when their bytes are; null counts as empty.  Of equal
    texts the row with the largest id stays (a null id is less than any
    other).  Rows with one id count each, and share one verdict.  Other
    columns are ignored, so none can clash; an empty table gives no rows.
    ``digest`` may be any function of the text: rows that collide are told
    apart by their bytes.
    """
    out = _verdicts(spark, path, id_col, text_col, digest)
    return out.select(F.col("id").alias(id_col), "digest", "keep_id", F.col("n").alias("group_size"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that do not stay; all columns as they are.

    Of rows with one id and one text one stays.  Nulls, empty texts and empty
    tables are treated as in :func:`exact_dedup`.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "dedup-input")
    docs.write.parquet(path)
    found = _verdicts(spark, path, id_col, text_col, sha256_of)
    stay = found.where("place = keep_place").select(F.col("place").alias("__stays"))
    rows = spark.read.schema(docs.schema).parquet(path).withColumn("__place", place_of())
    return rows.join(stay, F.col("__place") == F.col("__stays"), "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_exact_dedup(spark, sf_dir) -> DataFrame:
    """One row per document, dropped ones too."""
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
