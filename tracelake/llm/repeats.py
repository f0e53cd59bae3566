"""Repeated passages across documents by a sparse suffix array.

Positions are chosen by content: of the ``KGRAM``-word grams in any window of
``min_words`` words the one with the least hash is retained, so a passage of
that length has the same retained position wherever it stands.  A first pass
finds the retained grams that occur in more than one document (least and
greatest document per gram, combined in each task).  A second pass emits the
suffixes that begin with such a gram, with the words before and after as far
as a window reaches.  In each partition of grams the suffixes are sorted and
neighbours compared (longest common prefixes); for each number of words to the
left, suffixes that agree that far left and, by their neighbours, far enough
right are occurrences of one window.  The windows' union in a document is
what it shares.

Suffixes with equal surroundings are combined in each task: all but that of
the least document are settled there, so a passage in very many documents
costs each task one row.  A gram in very many places whose surroundings differ
would still make one large group: its windows go one by one through Spark's
aggregation (least and greatest document per window, combined in each task)
and a join, which Spark splits where one window is common.

Both passes read each text once, at any size.  The filter of repeated grams
between them has a fixed size; with very many of them it lets more suffixes
through that match nothing, and no result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import FILTER_BITS, Scratch, buffers, dealt, key_filter, materialise, mix, pack, partitions, passes, pieces, powers, small_batches, tidy, unpack, word_hashes

MIN_WORDS = 50
KGRAM = 16
#: Places of a gram from which on its windows are matched one by one.
HOT = 50_000
#: Text for each partition of the grams, suffixes of a partition in bytes, and places for each partition of the documents.
GRAM_BYTES, SUFFIX_BYTES, SPANS = 256 << 20, 8 << 20, 1_000_000
#: Suffixes that a task combines at once, and whose windows it sends together.
BUFFER, WINDOWED = 6000, 500
#: Columns of those windows: hash, document, first word, whether another document has it for sure.
WINDOW = ("w", "id", "begin", "known")

_ODDS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 128, dtype=np.uint64) | np.uint64(1)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of ``width`` values from each position on."""
    pick, n, have = (np.minimum if least else np.maximum), len(x) - width + 1, 1
    out = x
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out[:n]


def retained(words: np.ndarray, first: np.ndarray, min_words: int, kgram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of retained grams among all texts' words, and their hashes."""
    n = len(words) - kgram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for k in range(kgram):
        grams += words[k : k + n] * _ODDS[k]
    grams = mix(grams) >> np.uint64(1)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    bounds = first[1:-1]
    for k in range(1, kgram):  # grams that run into the next text
        at = bounds - k
        grams[at[(at >= 0) & (at < n)]] = none
    width = min_words - kgram + 1
    padded = np.r_[np.full(width - 1, none), grams, np.full(width - 1, none)]
    least = _sliding(padded, width, True)  # of every window that touches a gram
    best = _sliding(least, width, False)
    at = np.flatnonzero((grams == best) & (grams != none))
    return at, grams[at]


def _texts(part: pa.RecordBatch):
    data, offsets = buffers(part.column(1))
    words, _, _, first = word_hashes(data, offsets, lower=False)
    return part.column(0).to_numpy(), words, first


def _gram_rows(count: int, min_words: int, kgram: int):
    """Least and greatest document of each retained gram, by partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for part in pieces(batch, 1 << 20):
                ids, words, first = _texts(part)
                at, grams = retained(words, first, min_words, kgram)
                held.append((grams, ids[np.searchsorted(first, at, "right") - 1]))
            if held:
                grams, docs = (np.concatenate(x) for x in zip(*held, strict=True))
                found = _pack_ends(grams, docs, count) if len(grams) else []
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], names=["p", "blob"])

    return rows


def _ends(grams: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    by = np.argsort(grams, kind="stable")
    grams, low, high, n = grams[by], low[by], high[by], n[by]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
    if not len(first):
        return grams, low, high, n
    return grams[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.add.reduceat(n, first)


def _pack_ends(grams: np.ndarray, docs: np.ndarray, count: int) -> list[tuple[int, bytes]]:
    grams, *ends = _ends(grams, docs, docs, np.ones(len(docs), np.int64))
    return pack((mix(grams) % np.uint64(count)).astype(np.int64), count, grams, *ends)


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """Grams of more than one document and their places, and the places of all grams (no key)."""
    grams, low, high, n = _ends(*unpack(list(group["blob"]), "<u8", "<i8", "<i8", "<i8"))
    several = low != high
    keys = pd.array(np.r_[grams[several].view(np.int64), 0], dtype="Int64")
    keys[-1] = pd.NA
    tidy()
    return pd.DataFrame({"key": keys, "n": np.r_[n[several], n.sum()]})


def _windows(group_keys: np.ndarray, docs: np.ndarray, known: np.ndarray, pos: np.ndarray, size: np.ndarray, around: np.ndarray, min_words: int, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated windows of sorted suffixes: suffix, words to its left, whether a lesser document has it."""
    n, right = len(docs), around.shape[1] - left
    after = around[:, left:]
    # common prefixes of neighbours, from the gram on
    same = (after[1:] == after[:-1]) & (group_keys[1:] == group_keys[:-1])[:, None]
    common = np.where(same.all(1), right, np.argmin(same, 1))
    behind = np.zeros(n, np.uint64)
    out = []
    for l in range(left + 1):  # noqa: E741
        if l:
            behind = mix(behind * np.uint64(3) + around[:, left - l].astype(np.uint64) * _ODDS[l])
        need = min_words - l
        valid = (pos >= l) & (pos - l + min_words <= size)
        if need > right or not valid.any():
            continue
        run = np.r_[0, np.cumsum(common < need)].astype(np.uint64)
        i = np.flatnonzero(valid)
        key = mix(behind[i] + run[i] * np.uint64(0x9E3779B97F4A7C15))
        by = np.lexsort((docs[i], key))
        i, key = i[by], key[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[first, len(key)])
        low = np.repeat(docs[i[first]], length)
        several = np.repeat((docs[i[np.r_[first[1:], len(key)] - 1]] != docs[i[first]]) | np.logical_or.reduceat(known[i], first), length)
        out.append((i[several], np.full(several.sum(), l), docs[i[several]] != low[several]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _spans(docs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans within each document."""
    if not len(docs):
        return docs, begin, end
    by = np.lexsort((begin, docs))
    docs, begin, end = docs[by], begin[by], end[by]
    # ends grow from document to document, so that one running maximum serves all
    place = np.r_[0, np.cumsum(docs[1:] != docs[:-1])]
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + place * wide)
    fresh = np.r_[True, begin[1:] + place[1:] * wide > reach[:-1]]
    at = np.flatnonzero(fresh)
    return docs[at], begin[at], (reach - place * wide)[np.r_[at[1:], len(docs)] - 1]


def _suffix_rows(count: int, parts: int, min_words: int, kgram: int, needed, hot, buffer: int):
    """Suffixes by partition of their gram (kind 0), spans settled here by partition of their document (kind 1), windows of common grams (kind 2)."""
    left = min_words - kgram
    width = left + min_words
    base = int(_ODDS[0])
    forward, backward = powers(base, width), powers(pow(base, -1, 1 << 64), width)

    def windows(doc, pos, size, around, known) -> tuple[np.ndarray, ...]:
        """Each window over these suffixes' grams, as ``WINDOW`` names it."""
        sums = np.zeros((len(doc), width + 1), np.uint64)
        np.cumsum(mix(around.astype(np.uint64)) * forward, axis=1, out=sums[:, 1:])
        out = []
        for l in range(left + 1):  # noqa: E741
            i = np.flatnonzero((pos >= l) & (pos - l + min_words <= size))
            key = mix((sums[i, left - l + min_words] - sums[i, left - l]) * backward[left - l])
            out.append((key.view(np.int64), doc[i], pos[i] - l, known[i].astype(np.int64)))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def settle(held: list[tuple]) -> list[tuple]:
        gram, doc, pos, size, around = (np.concatenate(x) for x in zip(*held, strict=True))
        key = gram.copy()
        for k in range(width):
            key = mix(key * np.uint64(3) + around[:, k].astype(np.uint64) * _ODDS[k % 128])
        by = np.lexsort((pos, doc, key))
        gram, doc, pos, size, around, key = (x[by] for x in (gram, doc, pos, size, around, key))
        first = np.r_[True, key[1:] != key[:-1]]
        begin = np.flatnonzero(first)
        length = np.diff(np.r_[begin, len(key)])
        low = np.repeat(doc[begin], length)
        more = np.logical_or.reduceat(doc != low, begin)
        done = np.repeat(more, length) & (doc != low)
        rows = []
        if done.any():
            # every window around these that lies in the text is in a lesser document too
            b = np.maximum(pos[done] - left, 0)
            e = np.minimum(pos[done] + min_words, size[done])
            ok = e - b >= min_words
            d, b, e = _spans(doc[done][ok], b[ok], e[ok])
            rows += [(1, p, blob) for p, blob in pack((mix(d.view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts, d, b, e, np.ones(len(d), np.int64))]
        stay = ~done
        known = np.repeat(more, length)[stay].astype(np.uint8)
        gram, doc, pos, size, around = (x[stay] for x in (gram, doc, pos, size, around))
        if hot is not None and (common := passes(hot.value, gram)).any():
            at = np.flatnonzero(common)
            for a in range(0, len(at), WINDOWED):
                rows.append((2, 0, None, *windows(*(x[at[a : a + WINDOWED]] for x in (doc, pos, size, around, known)))))
            gram, doc, pos, size, around, known = (x[~common] for x in (gram, doc, pos, size, around, known))
        to = (mix(gram) % np.uint64(count)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[by], np.arange(count + 1))
        for p in np.unique(to).tolist():
            i = by[bounds[p] : bounds[p + 1]]
            rows.append((0, p, b"".join((gram[i].tobytes(), doc[i].tobytes(), pos[i].tobytes(), size[i].tobytes(), around[i].tobytes(), known[i].tobytes()))))
        return rows

    def emit(rows):
        columns = list(zip(*((*r, *[None] * (7 - len(r))) for r in rows), strict=True))
        kinds = [pa.int32(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "p", "blob", *WINDOW])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = needed.value, [], 0
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                ids, words, first = _texts(part)
                at, grams = retained(words, first, min_words, kgram)
                wanted = passes(bits, grams)
                at, grams = at[wanted], grams[wanted]
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                low, high = first[row], first[row + 1]
                short = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                for a in range(0, len(at), buffer):
                    s = slice(a, a + buffer)
                    i = at[s, None] + np.arange(-left, min_words)[None, :]
                    inside = (i >= low[s, None]) & (i < high[s, None])
                    around = np.where(inside, short[np.clip(i, 0, len(short) - 1)], np.uint32(0))
                    held.append((grams[s], ids[row[s]], at[s] - low[s], high[s] - low[s], around))
                    n += len(around)
                    if n >= buffer:
                        yield emit(settle(held))
                        held, n = [], 0
        if held:
            yield emit(settle(held))
        tidy()

    return rows


def _match(parts: int, min_words: int, kgram: int):
    left = min_words - kgram
    width = left + min_words

    def match(group: pd.DataFrame) -> pd.DataFrame:
        columns: list[list] = [[] for _ in range(6)]
        for blob in group["blob"]:
            n, at = len(blob) // (33 + 4 * width), 0
            for k, (kind, each) in enumerate((("<u8", 1), ("<i8", 1), ("<i8", 1), ("<i8", 1), ("<u4", width), ("u1", 1))):
                columns[k].append(np.frombuffer(blob, kind, n * each, at))
                at += n * each * np.dtype(kind).itemsize
        gram, doc, pos, size, around, known = (np.concatenate(x) for x in columns)
        around = around.reshape(-1, width)
        # suffix order: by gram, then by the words from it on
        rows = np.ascontiguousarray(around[:, left:].astype(">u4")).view(f"V{4 * min_words}").ravel()
        by = np.lexsort((_order_of(rows), gram))
        gram, doc, pos, size, around, known = (x[by] for x in (gram, doc, pos, size, around, known))
        i, l, later = _windows(gram, doc, known.astype(bool), pos, size, around, min_words, left)  # noqa: E741
        found = []
        for dropped in (0, 1):
            some = later == bool(dropped)
            d, b, e = _spans(doc[i[some]], pos[i[some]] - l[some], pos[i[some]] - l[some] + min_words)
            found.append((d, b, e, np.full(len(d), dropped, np.int64)))
        d, b, e, f = (np.concatenate(x) for x in zip(*found, strict=True))
        out = pack((mix(d.view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts, d, b, e, f)
        tidy()
        return pd.DataFrame({"p": [p for p, _ in out], "blob": [x for _, x in out]})

    return match


def _order_of(rows: np.ndarray) -> np.ndarray:
    """Rank of each row of bytes, equal for equal rows."""
    return np.unique(rows, return_inverse=True)[1]


def _gather(group: pd.DataFrame) -> pd.DataFrame:
    doc, begin, end, dropped = unpack(list(group["blob"]), "<i8", "<i8", "<i8", "<i8")
    all_ = _spans(doc, begin, end)
    some = dropped == 1
    late = _spans(doc[some], begin[some], end[some])

    def told(d, b, e):
        pairs = pd.Series([[int(x), int(y)] for x, y in zip(b, e, strict=True)], dtype=object)
        return pairs.groupby(d).apply(list) if len(d) else pd.Series([], dtype=object)

    spans = told(*all_)
    drops = told(*late).reindex(spans.index)
    return pd.DataFrame({"id": spans.index.astype("int64"), "spans": spans.to_numpy(), "drop_spans": [x if isinstance(x, list) else [] for x in drops]})


def _common_spans(rows: DataFrame, parts: int, min_words: int, work: Scratch) -> DataFrame:
    """Spans by partition of their document, of windows over common grams (rows of arrays, kind 2)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, begin, late = (batch.column(i).to_numpy() for i in range(3))
            found = []
            for dropped in (0, 1):
                some = late == dropped
                d, b, e = _spans(doc[some], begin[some], begin[some] + min_words)
                found.append((d, b, e, np.full(len(d), dropped, np.int64)))
            d, b, e, f = (np.concatenate(x) for x in zip(*found, strict=True))
            out = pack((mix(d.view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts, d, b, e, f)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["p", "blob"])

    windows = rows.select(F.inline(F.arrays_zip(*WINDOW)))
    ends = windows.groupBy("w").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("known").alias("known"))
    ends = work.write(ends.where("low <> high OR known = 1").select("w", "low"), "repeat-windows")
    late = (F.col("id") != F.col("low")).cast("long")
    # a table of its own, so that no Python step of the join stands beside those after it
    return materialise(windows.join(ends, "w").select("id", "begin", late.alias("late")).mapInArrow(packed, "p bigint, blob binary"), "repeat-common")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, kgram: int = KGRAM, hot: int = HOT, buffer: int = BUFFER) -> DataFrame:
    """Documents that share a passage of ``min_words`` words or more with another one.

    Per such document: id, ``spans`` (arrays [first word, end word) of all it
    shares, ascending) and ``drop_spans`` (those of which a document with a
    lesser id has every window).  Words are cut at ASCII white space and
    compared as they are.  A null text is empty; shorter texts, texts that
    repeat only themselves and rows that repeat an id with the same text are
    not reported; a null id counts as one document, the least.  Ids are
    integers.  Other columns are left out, so none can clash; an empty table
    gives an empty result.  ``hot`` and ``buffer`` set how work is dealt, and
    change no result.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    work = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    null_id = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(null_id)).alias("id"), F.col(f"`{text_col}`").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    count = partitions(spark, size, GRAM_BYTES)
    grams = rows.mapInArrow(_gram_rows(count, min_words, kgram), "p bigint, blob binary")
    found = work.write(dealt(grams, count, "p").groupBy("p").applyInPandas(_repeated, "key bigint, n bigint"), "repeat-grams")
    keys = found.where("key IS NOT NULL")
    known, places, common, total = found.agg(F.count("key"), F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.count_if(F.col("key").isNotNull() & (F.col("n") > hot)), F.sum(F.when(F.col("key").isNull(), F.col("n")))).first()
    # suffixes to come: those of repeated grams, and what the filter lets through besides
    expected = (places or 0) + min(1.0, known / (1 << FILTER_BITS)) * (total or 0)
    count, parts = partitions(spark, expected * (33 + 4 * (2 * min_words - kgram)), SUFFIX_BYTES), partitions(spark, expected, SPANS)
    needed = spark.sparkContext.broadcast(key_filter(keys.select("key")))
    often = spark.sparkContext.broadcast(key_filter(keys.where(F.col("n") > hot).select("key"))) if common else None
    suffixes = materialise(rows.mapInArrow(_suffix_rows(count, parts, min_words, kgram, needed, often, buffer), "kind int, p bigint, blob binary, " + ", ".join(f"{c} array<bigint>" for c in WINDOW)), "repeat-suffixes")
    spans = dealt(suffixes.where("kind = 0").select("p", "blob"), count, "p").groupBy("p").applyInPandas(_match(parts, min_words, kgram), "p bigint, blob binary").union(suffixes.where("kind = 1").select("p", "blob"))
    if common:
        # windows' ends go when the spans over them are written
        spans = spans.union(_common_spans(suffixes.where("kind = 2").select(*WINDOW), parts, min_words, work))
    work.clear()
    out = dealt(spans, parts, "p").groupBy("p").applyInPandas(_gather, "id bigint, spans array<array<bigint>>, drop_spans array<array<bigint>>")
    return out.select(F.nullif("id", F.lit(null_id)).cast(kind).alias(id_col), "spans", "drop_spans")


def cut_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of ``drop_spans`` cut from their texts (other columns as they are)."""
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(text_col).to_pylist(), batch.column("__drop").to_pylist(), strict=True):
                if text is not None and spans:
                    at = [(m.start(), m.end()) for m in word.finditer(text)]
                    for a, b in reversed(spans):
                        text = text[: at[a][0]] + text[at[b - 1][1] :]
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(i) for i, f in enumerate(batch.schema) if f.name != "__drop"]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in batch.schema if f.name != "__drop"])

    drops = found.select(F.col(id_col).alias("__id"), F.col("drop_spans").alias("__drop"))
    joined = docs.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left").drop("__id")
    return joined.mapInArrow(cut, docs.schema)


def op10_repeated_passages(spark, sf_dir) -> DataFrame:
    """One row per document with a passage of 50 words or more that another document has too."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[0], x[1])), ",")
    size = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), size("spans").alias("repeated_words"), size("drop_spans").alias("drop_words"), told("spans").alias("spans"), told("drop_spans").alias("drop_spans"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM i),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS low, max(doc_id) OVER (PARTITION BY h) AS high FROM h),
k AS (SELECT doc_id, i, false AS dropped FROM g WHERE low <> high UNION ALL SELECT doc_id, i, true FROM g WHERE low < doc_id),
f AS (SELECT *, coalesce(i - lag(i) OVER (PARTITION BY dropped, doc_id ORDER BY i) > 50, true) AS fresh FROM k),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY dropped, doc_id ORDER BY i) AS run FROM f),
s AS (SELECT dropped, doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY 1, 2, 3)
SELECT doc_id, count(*) FILTER (NOT dropped) AS n_spans, (sum(b - a) FILTER (NOT dropped))::BIGINT AS repeated_words,
       coalesce(sum(b - a) FILTER (dropped), 0)::BIGINT AS drop_words,
       string_agg(a || ':' || b, ',' ORDER BY a) FILTER (NOT dropped) AS spans,
       coalesce(string_agg(a || ':' || b, ',' ORDER BY a) FILTER (dropped), '') AS drop_spans
FROM s GROUP BY 1
"""
