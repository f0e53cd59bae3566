"""Importance resampling of documents towards a target text, by hashed n-grams.

Features are the runs of one to three words, hashed into buckets by the CRC-32
of their bytes.  A bucket's gain is the log ratio of its smoothed shares in
the target and in the corpus; a document's weight is the sum over its
features, its score adds Gumbel noise from a hash of its id, and the highest
scores are drawn: a sample without replacement in proportion to exp(weight).

A text of more than ``CHUNK_WORDS`` words is cut at word boundaries into
chunks that carry the next two words and own the features that start in their
own words, so chunks' counts and weights add up to the document's.  The chunks
of long texts are dealt over all tasks; other texts are their own only chunk
and stay where they are read.  Texts are read twice: for the counts, and for
the weights.  Counts of buckets (10,000 at most) are all that is broadcast.

The CRC of a run of words follows from its words' own: the register after
``x + y`` is the register after ``x`` advanced over ``len(y)`` zero bytes, XOR
the register of ``y`` from zero.  Both are table lookups over whole batches.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, buffers, materialise, partitions, pieces, small_batches, tidy, word_bounds

WIDTH = 3
BUCKETS = 10_000
#: Words that a chunk owns; longer texts are cut.
CHUNK_WORDS = 4096
#: Chunks of a task.
TASK_CHUNKS = 500
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Bytes of words: digits, letters, and all of what is not ASCII.
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FULL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_TABLE = _byte_table()
#: Registers advanced over so many zero bytes, by each byte of the register.
_AHEAD = np.empty((256, 4, 256), np.uint32)
_AHEAD[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
for _i in range(1, 256):
    _AHEAD[_i] = _TABLE[_AHEAD[_i - 1] & 255] ^ _AHEAD[_i - 1] >> 8


def _advance(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """CRC registers after ``count`` zero bytes each."""
    step = np.minimum(count, 255)
    out = _AHEAD[step, 0, state & 255] ^ _AHEAD[step, 1, state >> 8 & 255] ^ _AHEAD[step, 2, state >> 16 & 255] ^ _AHEAD[step, 3, state >> 24]
    far = np.flatnonzero(count > 255)
    if len(far):
        out[far] = _advance(out[far], count[far] - 255)
    return out


def _word_states(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC registers of the words' bytes, from zero."""
    length = end - start
    out = np.zeros(len(start), np.uint32)
    by = np.argsort(-length, kind="stable")
    long = int(np.searchsorted(-length[by], -64, "left"))  # words of more than 64 bytes
    for i in by[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]]) ^ 0xFFFFFFFF
    if long:
        out[by[:long]] ^= _advance(np.full(long, _FULL), length[by[:long]])
    by = by[long:]
    at, left = start[by], length[by]
    state = np.zeros(len(by), np.uint32)
    for j in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -j, "left"))  # those that have a byte j
        state[:m] = _TABLE[(state[:m] ^ data[at[:m] + j]) & 255] ^ state[:m] >> 8
    out[by] = state
    return out


def features(data: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and for all features their text and bucket.

    With ``own`` only features that start in a text's first so many words
    count, and these are its words.
    """
    data = _LOWER[data]
    start, end = word_bounds(data, offsets, _GAP)
    first = np.searchsorted(start, offsets)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(start)) - np.repeat(first[:-1], count)
    owned = count if own is None else np.minimum(own, count)
    mine = place < owned[text] if len(text) else np.zeros(0, bool)
    bare, length = _word_states(data, start, end), end - start
    state = _advance(np.full(len(start), _FULL), length) ^ bare
    texts, found = [text[mine]], [(state ^ _FULL)[mine]]
    for k in range(1, width):
        # each register moves on by a space and the word k places further
        state = _TABLE[(state[:-1] ^ 32) & 255] ^ state[:-1] >> 8 if len(state) else state
        state = _advance(state, length[k:]) ^ bare[k:]
        ok = mine[: len(state)] & (text[: len(state)] == text[k:])
        texts.append(text[: len(state)][ok])
        found.append((state ^ _FULL)[ok])
    return owned, np.concatenate(texts), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def chunks(text: str, words: int = CHUNK_WORDS, width: int = WIDTH) -> list[tuple[str, int]]:
    """A text's chunks with the number of words that each owns; they also carry the next ``width - 1``."""
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end = word_bounds(raw, np.array([0, len(raw)]), _GAP)
    out = []
    for a in range(0, len(start), words):
        last = min(a + words + width - 1, len(start)) - 1
        out.append((raw[start[a] : end[last]].tobytes().decode(), min(words, len(start) - a)))
    return out


def _survey(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """Counts of buckets (bucket, n) of the texts that are not cut, and the chunks (id, doc, chunk, own, piece) of the others; ``doc`` names a row."""
    kind = docs.schema["id"].dataType.simpleString()

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, row = np.zeros(buckets, np.int64), TaskContext.get().partitionId() << 33
        names, id_type = ["bucket", "n", "id", "doc", "chunk", "own", "piece"], None
        for batch in batches:
            id_type = batch.column(0).type
            for part in pieces(batch):
                count, text, bucket = features(*buffers(part.column(1)), buckets=buckets)
                long = count > words
                total += np.bincount(bucket[~long[text]], minlength=buckets)
                for i in np.flatnonzero(long).tolist():
                    cut = chunks(part.column(1)[i].as_py(), words)
                    m = len(cut)
                    none = pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), none, pa.concat_arrays([part.column(0).slice(i, 1)] * m), pa.array([row + i] * m), pa.array(range(m), pa.int32()), pa.array([x[1] for x in cut]), pa.array([x[0] for x in cut])], names=names)
                row += part.num_rows
        at = np.flatnonzero(total)
        if len(at):
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at]), pa.nulls(len(at), id_type), none, pa.nulls(len(at), pa.int32()), none, pa.nulls(len(at), pa.string())], names=names)
        tidy()

    return docs.mapInArrow(survey, f"bucket int, n bigint, id {kind}, doc bigint, chunk int, own bigint, piece string")


def _chunk_counts(cut: DataFrame, buckets: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, _, bucket = features(*buffers(batch.column(1)), batch.column(0).to_numpy(), buckets=buckets)
            total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return cut.select("own", "piece").mapInArrow(count, "bucket int, n bigint")


def bucket_counts(docs: DataFrame, work: Scratch, words: int = CHUNK_WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, DataFrame]:
    """Features of all texts by bucket, and the chunks of the long ones, dealt evenly.  ``docs``: id, body."""
    survey = work.write(_survey(docs, words, buckets), "resample-survey")
    cut = survey.where("piece IS NOT NULL").select("id", "doc", "chunk", "own", "piece")
    cut = cut.repartition(partitions(docs.sparkSession, cut.count(), TASK_CHUNKS), "doc", "chunk")
    counts = survey.where("bucket IS NOT NULL").select("bucket", "n").union(_chunk_counts(cut, buckets))
    out = np.zeros(buckets, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one for each bucket
        out[row.bucket] = row.n
    return out, cut


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket."""
    t, s, m = float(target.sum()), float(corpus.sum()), float(len(target))
    return np.array([math.floor(1000 * math.log((float(a) + 1) * (s + m) / ((float(b) + 1) * (t + m)))) for a, b in zip(target, corpus, strict=True)], np.int64)


def _weights(docs: DataFrame, cut: DataFrame, gain: np.ndarray, words: int) -> DataFrame:
    """id, n_words, n_features, weight of every row."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "n_words", "n_features", "weight"]

    def weigh(body: pa.Array, own: np.ndarray | None) -> list[np.ndarray]:
        count, text, bucket = features(*buffers(body), own, buckets=len(held.value))
        # sums of 64-bit integers: a weighted bincount would go through doubles
        by = np.argsort(text, kind="stable")
        sums = np.r_[np.int64(0), np.cumsum(held.value[bucket[by]])]
        n = np.bincount(text, minlength=len(body))
        ends = np.cumsum(n)
        return [count.astype(np.int64), n.astype(np.int64), sums[ends] - sums[ends - n]]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                columns = weigh(part.column(1), None)
                stay = pa.array(columns[0] <= words)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=names).filter(stay)
        tidy()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, weigh(batch.column(3), batch.column(2).to_numpy()))], names=["doc", *names])
        tidy()

    schema = f"id {kind}, n_words bigint, n_features bigint, weight bigint"
    long = cut.select("doc", "id", "own", "piece").mapInArrow(parts, f"doc bigint, {schema}")
    long = long.groupBy("doc").agg(F.first("id").alias("id"), *(F.sum(c).alias(c) for c in names[1:])).select(names)
    return docs.mapInArrow(whole, schema).unionByName(long)


def _ranked(scored: DataFrame, work: Scratch) -> DataFrame:
    """``scored`` with its ``place`` (from 1) by score, ties to the lesser id: a sort by ranges, to each row its range's start and its number within."""
    dealt = scored.orderBy(F.desc("score"), F.asc_nulls_last("id")).withColumn("at", F.monotonically_increasing_id())
    dealt = work.write(dealt, "resample-order").withColumn("range", F.shiftright("at", 33))
    sizes = {r["range"]: r["count"] for r in dealt.groupBy("range").count().collect()}  # one for each partition
    starts, before = [], 0
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    starts = scored.sparkSession.createDataFrame(starts, "range bigint, before bigint")
    return dealt.join(starts, "range").withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, words: int = CHUNK_WORDS) -> DataFrame:
    """Per row: id, n_words, n_features, weight, score and ``rank``, its place among those drawn (null if it isn't).

    A-Z count as a-z; words are runs of digits, letters and what is not ASCII.
    Drawn are ``percent`` per cent (rounded down) of the rows with at least
    ``least_words`` words, highest scores first, ties to the lesser id.  A
    null text has no features and weight 0; a null id has the noise of the
    empty text and comes last among ties; repeated rows count and are drawn
    one by one; other columns are left out, so none can clash; an empty table
    gives none, an empty target the weights of uniform shares.  ``words`` sets
    where long texts are cut, and changes no result.
    """
    small_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    goal, _ = bucket_counts(target.select(F.lit(0).alias("id"), F.col(f"`{target_col}`").alias("body")), work, words, buckets)
    corpus, cut = bucket_counts(rows, work, words, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = work.write(_weights(rows, cut, gains(goal, corpus), words).withColumn("score", F.col("weight") + noise), "resample-scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    places = _ranked(scored.where(able), work)
    columns = ["id", "n_words", "n_features", "weight", "score"]
    out = places.select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    out = out.union(scored.where(~able).select(*columns, F.lit(None).cast("long")))
    out = materialise(out.withColumnRenamed("id", id_col), "resample")
    work.clear()
    return out


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` that :func:`resample` draws, all columns as they are; rows with one id stay if any of them is drawn."""
    found = resample(docs, target, id_col, text_col, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("__id"))
    return docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left_semi")


def op12_resample(spark, sf_dir) -> DataFrame:
    """Every document's features, weight, score and rank, as :func:`resample` has them, against all texts of ``benchmark``."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target.select("text")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
i AS (SELECT side, id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
r AS (SELECT side, id, w, i, unnest([1, 2, 3]) AS k FROM i),
g AS (SELECT side, id, array_to_string(w[i:i + k - 1], ' ') AS f, count(*) AS n FROM r WHERE i + k - 1 <= len(w) GROUP BY ALL),
f AS (SELECT f, hex(encode(f)) AS x, octet_length(encode(f)) AS len FROM (SELECT DISTINCT f FROM g)),
bits AS (SELECT b, b AS v, 0 AS k FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
most AS MATERIALIZED (SELECT max(len) AS m FROM f),
a AS (SELECT b, v, 0 AS k FROM tab UNION ALL SELECT a.b, xor(tab.v, a.v >> 8), k + 1 FROM a JOIN tab ON tab.b = a.v & 255 WHERE k + 1 < (SELECT m FROM most)),
z AS (SELECT 4294967295::BIGINT AS v, 0 AS k UNION ALL SELECT xor(tab.v, z.v >> 8), k + 1 FROM z JOIN tab ON tab.b = z.v & 255 WHERE k < (SELECT m FROM most)),
y AS (SELECT f, len, unnest(range(len)) AS j, x FROM f),
c AS (
  SELECT f, any_value(len) AS len, bit_xor(a.v::BIGINT) AS v
  FROM y JOIN a ON a.k = y.len - 1 - y.j AND a.b = ('0x' || substr(y.x, 2 * y.j + 1, 2))::BIGINT GROUP BY f),
h AS (SELECT f, xor(xor(c.v, z.v), 4294967295) % 10000 AS bucket FROM c JOIN z ON z.k = c.len),
t AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM g JOIN h USING (f) GROUP BY bucket),
u AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM t),
b AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0)::DOUBLE + 1) * (u.s + 10000) / ((coalesce(t.s, 0)::DOUBLE + 1) * (u.t + 10000))))::BIGINT AS gain FROM t, u),
d AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM g JOIN h USING (f) JOIN b USING (bucket) WHERE side = 0 GROUP BY id),
e AS (
  SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w.w) AS words,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d ON d.id = w.id WHERE side = 0),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE words >= 20)
SELECT e.doc_id, e.n_features, e.weight, e.score, CASE WHEN o.rank <= floor(5 * n / 100) THEN o.rank END AS rank
FROM e LEFT JOIN o USING (doc_id)
"""
