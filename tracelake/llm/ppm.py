"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts up to ``order``, kept as sorted arrays of
packed n-grams with counts.  Escapes are estimated by method D: a byte's
probability is its count less a half over the context's total, and the halves
of all distinct successors are the probability of escaping to the next shorter
context, where the successors already seen are excluded from totals and from
the escape estimate.  After the shortest context all bytes not seen yet share
evenly.

Counting: documents lie in blocks (rows beside each other in a file); each
block sends, packed and by hash partition, its distinct n-grams and words with
their counts (none for those of held-out rows alone).  Distinct n-grams are
dealt again by the last two bytes of their contexts, so that all longer
contexts of an n-gram lie together, and each gets its log probability there.
Where two bytes have more n-grams than a task should hold, these are dealt by
three, and so on.  Of the contexts that are shorter than what an n-gram is
dealt by the successors' counts are broadcast: those of byte pairs, 65,536 at
most in any corpus, and those of ``HOT`` contexts of each length at most.
Each block gets back the log probabilities of its own n-grams
and the counts of its own words, so the model has its full order at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import buffers, dealt, materialise, pack, partitions, pieces, small_batches, tidy, unpack, word_hashes

#: Stands before and after each text; no UTF-8 text contains it.
EDGE = 0xFF
END_TOKEN = np.uint64(0x9E3779B97F4A7C15)
ORDER = 5
#: Text of a block.
BLOCK_BYTES = 16 << 20
#: Text for each partition of the counts.
PART_BYTES = 64 << 20
#: Distinct n-grams of a task that gives them their probabilities, about.
MAX_NODES = 500_000
#: Bytes of a context by which n-grams are dealt; shorter contexts are broadcast.
NEAR = 2
#: Contexts of one length that are dealt by a byte more, at most.
HOT = 1 << 13


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order+1)-gram that ends at each symbol, the end mark of each text included, and where each text's begin.

    A gram is packed with its last byte lowest.  Before a text stand
    ``order`` marks.
    """
    n, rows = len(data), len(offsets) - 1
    pad = order + 1
    # each text with one mark after it; those before it come by masking
    spread = np.full(n + rows, EDGE, np.uint8)
    where = np.arange(n) + np.repeat(np.arange(rows), np.diff(offsets))
    spread[where] = fold(data)
    begins = offsets + np.arange(rows + 1)
    out = spread.astype(np.uint64)
    behind = np.empty(len(spread), np.uint64)
    for k in range(1, pad):
        behind[:k] = EDGE
        behind[k:] = spread[:-k]
        out |= behind << np.uint64(8 * k)
    # symbols of the text before, and whatever stands before the mark, are marks
    for k in range(1, pad):
        at = begins[:-1, None] + np.arange(k)[None, :]
        at = at[(at < begins[1:, None]) if k > 1 else np.ones_like(at, bool)]
        out[at] |= np.uint64(EDGE) << np.uint64(8 * k)
    return out, begins


def _count(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.r_[first, len(codes)])


def _sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values[:0]


def _pack_sorted(to: np.ndarray, count: int, keys: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes]]:
    """As :func:`pack`, of ascending keys and values: differences and values, byte by byte, compressed."""
    order = np.argsort(to, kind="stable")
    keys, values = keys[order], values[order]
    bounds = np.searchsorted(to[order], np.arange(count + 1))
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    out = []
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[p], bounds[p + 1]
        out.append((p, zlib.compress(planes(np.diff(keys[a:b], prepend=keys.dtype.type(0))) + planes(values[a:b]), 1)))
    return out


def _unpack_sorted(blobs: list[bytes], key_kind: str, kind: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Inverse of :func:`_pack_sorted`: keys and values of each blob."""
    wide, narrow = np.dtype(key_kind).itemsize, np.dtype(kind).itemsize
    keys, values = [], []
    for blob in blobs:
        raw = np.frombuffer(zlib.decompress(blob), np.uint8)
        n = len(raw) // (wide + narrow)
        keys.append(np.cumsum(np.ascontiguousarray(raw[: wide * n].reshape(wide, n).T).view(key_kind).ravel(), dtype=key_kind))
        values.append(np.ascontiguousarray(raw[wide * n :].reshape(narrow, n).T).view(kind).ravel())
    return keys, values


def _home(keys: np.ndarray, count: int) -> np.ndarray:
    """Partition of n-grams or words by hash."""
    return ((keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(count)).astype(np.int64)


def _ends(codes: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes of codes."""
    return codes & np.uint64((1 << 8 * n) - 1)


@dataclass
class Level:
    """n-grams of one length: sorted codes, their counts, and per gram its context's totals."""

    codes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    #: Of each context: the sum of its successors' counts in the next shorter context.
    below: np.ndarray


class Trie:
    """PPM model from the counts of (order+1)-grams.

    ``short`` are the whole corpus's counts of ``near``-grams, where
    ``codes`` hold only all those with some contexts of ``near`` bytes; ``hot``
    has, by length, the contexts of which they hold but a part, and the
    whole corpus's counts of what follows these; ``asked`` are all grams that
    will be asked for.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, near: int = 0, short: tuple[np.ndarray, np.ndarray] | None = None, hot: dict[int, tuple] | None = None, asked: np.ndarray | None = None):
        self.order = order
        self.levels: list[Level] = []
        by_length = {order: (codes, counts.astype(np.int64))}
        for k in range(order - 1, -1, -1):
            longer = by_length[k + 1]
            if short is not None and k == near - 1:
                by_length[k] = short
                continue
            by_length[k] = _sum(longer[0] & np.uint64((1 << 8 * (k + 1)) - 1), longer[1])
            if hot and k in hot:
                own, (contexts, whole, sums) = by_length[k], hot[k]
                part = np.isin(own[0] >> np.uint64(8), contexts)
                here = np.isin(whole >> np.uint64(8), _ends(asked >> np.uint64(8), k))
                by_length[k] = _sum(np.r_[own[0][~part], whole[here]], np.r_[own[1][~part], sums[here]])
        for k in range(order + 1):
            codes, counts = by_length[k]
            contexts = codes >> np.uint64(8)
            first = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(codes) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, first) if len(first) else counts[:0]
            distinct = np.diff(np.r_[first, len(codes)])
            below = np.zeros(len(first), np.int64)
            if k and len(first):
                shorter = by_length[k - 1]
                of = shorter[1][np.searchsorted(shorter[0], codes & np.uint64((1 << 8 * k) - 1))]
                below = np.add.reduceat(of, first)
            self.levels.append(Level(codes, counts, contexts[first], total, distinct, below))
        self._index()

    def _index(self) -> None:
        """A hash table from the longest grams to their log10 probability."""
        top = self.levels[self.order]
        bits = max(10, int(max(1, len(top.codes)) * 2 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << bits, np.float32)
        of = np.searchsorted(top.contexts, top.codes >> np.uint64(8))
        logs = np.log10((2 * top.counts - 1) / (2 * top.total[of])) if len(top.codes) else np.zeros(0)
        at = self._slot(top.codes)
        # of the grams with one slot the commonest stands there; the others are searched
        order = np.argsort(top.counts, kind="stable")
        self.keys[at[order]], self.values[at[order]] = top.codes[order], logs[order]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (order+1)-gram after the bytes before it."""
        at = self._slot(codes)
        out = self.values[at].astype(np.float64)
        rest = np.flatnonzero(self.keys[at] != codes)
        if len(rest):
            found, inverse = np.unique(codes[rest], return_inverse=True)
            out[rest] = self._slow(found)[inverse]
        return out

    def _slow(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        open_ = np.ones(len(codes), bool)
        seen = np.zeros(len(codes), np.int64)  # distinct symbols excluded so far
        gone = np.zeros(len(codes), np.int64)  # their counts in the context at hand
        for k in range(self.order, -1, -1):
            level = self.levels[k]
            i = np.flatnonzero(open_)
            if not len(i) or not len(level.codes):
                continue
            short = codes[i] & np.uint64((1 << 8 * (k + 1)) - 1)
            context = short >> np.uint64(8)
            c = np.minimum(np.searchsorted(level.contexts, context), len(level.contexts) - 1)
            known = level.contexts[c] == context
            i, short, c = i[known], short[known], c[known]
            total, distinct = level.total[c] - gone[i], level.distinct[c] - seen[i]
            g = np.minimum(np.searchsorted(level.codes, short), len(level.codes) - 1)
            hit = level.codes[g] == short
            out[i[hit]] += np.log10((2 * level.counts[g[hit]] - 1) / (2 * total[hit]))
            open_[i[hit]] = False
            miss = ~hit & (total > 0)
            out[i[miss]] += np.log10(distinct[miss] / (2 * total[miss]))
            seen[i[~hit]] = level.distinct[c[~hit]]
            gone[i[~hit]] = level.below[c[~hit]]
        out[open_] -= np.log10(np.maximum(256 - seen[open_], 1))
        return out


class Prices:
    """log10 probabilities of a block's own (order+1)-grams."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray, order: int):
        by = np.argsort(codes)
        self.codes, self.logs, self.order = codes[by], logs[by], order
        bits = max(10, int(max(1, len(codes)) * 4 - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        # no n-gram is as large as an empty slot's mark: the order is 6 at most
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << bits, np.float32)
        at = self._slot(self.codes)
        self.keys[at], self.values[at] = self.codes, self.logs

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        at = self._slot(codes)
        out = self.values[at].astype(np.float64)
        rest = np.flatnonzero(self.keys[at] != codes)
        if len(rest):
            i = np.searchsorted(self.codes, codes[rest])
            if i.max() >= len(self.codes) or (self.codes[i] != codes[rest]).any():
                raise ValueError("a block has other n-grams than it sent")
            out[rest] = self.logs[i]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its end included."""
        codes, begins = grams(data, offsets, self.order)
        return np.add.reduceat(self.log10(codes), begins[:-1]) if len(codes) else np.zeros(0)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Documents as id (text), body, held and block: rows that lie together in a file, about ``BLOCK_BYTES`` of text; and the bytes of all text.

    A row's file and number in it are the same in every scan, so the blocks
    are too, whatever the splits.  A range of rows with much more text than
    usual is cut into as many blocks as its bytes ask for.
    """
    length = F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    size, n = docs.agg(F.sum(length), F.count(F.lit(1))).first()
    rows = min(200_000, max(1, int(BLOCK_BYTES * n / max(1, size or 0)))) if n else 1
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    row = F.col("_metadata.row_index")
    placed = docs.select(
        F.col(f"`{id_col}`").cast("string").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"),
        (F.crc32(key) % 7 == 2).alias("held"),
        F.xxhash64("_metadata.file_path", F.floor(row / rows)).alias("range"),
        F.pmod(row, F.lit(rows)).alias("within"),
    )
    bytes_ = docs.select(length.alias("n"), F.xxhash64("_metadata.file_path", F.floor(row / rows)).alias("range")).groupBy("range").agg(F.sum("n").alias("n"))
    wide = materialise(bytes_.where(F.col("n") > 2 * BLOCK_BYTES).select("range", F.ceil(F.col("n") / BLOCK_BYTES).alias("parts")), "ppm-ranges")
    if wide.isEmpty():
        return placed.select("id", "body", "held", F.col("range").alias("block")), size or 0
    part = F.floor(F.col("within") * F.coalesce("parts", F.lit(1)) / rows)
    return placed.join(wide, "range", "left").select("id", "body", "held", F.xxhash64("range", part).alias("block")), size or 0


def _gather(blocks: DataFrame, order: int, count: int) -> DataFrame:
    """Packed counts by kind (g: grams, w: words), partition and block."""

    def packed(block: int, gram_parts: list, word_parts: list) -> pa.RecordBatch:
        rows = []
        for name, found in (("g", gram_parts), ("w", word_parts)):
            keys, sums = _sum(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found]))
            # a block is small enough for counts of 32 bits
            put = _pack_sorted if name == "g" else pack
            rows += [(name, p, block, blob) for p, blob in put(_home(keys, count), count, keys, sums.astype(np.uint32))]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["kind", "p", "block", "blob"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gram_parts, word_parts = None, [], []
        for batch in batches:
            ids = batch.column("block").to_numpy()
            cuts = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b == a:
                    continue
                if at is not None and at != ids[a]:
                    yield packed(at, gram_parts, word_parts)
                    gram_parts, word_parts = [], []
                at = int(ids[a])
                for piece in pieces(batch.slice(a, b - a).select(["body", "held"]), 1 << 20):
                    data, offsets = buffers(piece.column(0))
                    train = ~piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                    codes, begins = grams(data, offsets, order)
                    learnt = np.repeat(train, np.diff(begins))
                    gram_parts.append(_count(codes[learnt]))
                    asked = _count(codes[~learnt])[0]
                    gram_parts.append((asked, np.zeros(len(asked), np.int64)))
                    words, _, _, first = word_hashes(data, offsets)
                    one = np.repeat(train, np.diff(first)).astype(np.int64)
                    word_parts.append(_sum(np.r_[words, END_TOKEN], np.r_[one, train.sum()]))
        if at is not None:
            yield packed(at, gram_parts, word_parts)
        tidy()

    return blocks.select("body", "held", "block").mapInArrow(gather, "kind string, p bigint, block bigint, blob binary")


def _reduce(group: pd.DataFrame) -> pd.DataFrame:
    """One partition's grams with their counts, and for each block the places of its own; or for each block the counts of its own words."""
    blobs, blocks, kind, p = list(group["blob"]), group["block"].to_numpy(), group["kind"].iloc[0], int(group["p"].iloc[0])
    if kind == "g":
        parts, counts = _unpack_sorted(blobs, "<u8", "<u4")
        keys, sums = _sum(np.concatenate(parts), np.concatenate(counts).astype(np.int64))
        rows = [("g", 0, blob, 0, len(keys)) for _, blob in _pack_sorted(np.zeros(len(keys), np.int64), 1, keys, sums)]
        for block, own in zip(blocks.tolist(), parts, strict=True):
            at = np.searchsorted(keys, own).astype(np.uint32)
            rows.append(("i", block, zlib.compress(np.diff(at, prepend=np.uint32(0)).tobytes(), 1), 0, 0))
    else:
        keys, counts = unpack(blobs, "<u8", "<u4")
        who = np.repeat(np.arange(len(blobs)), [len(b) // 12 for b in blobs])
        known, inverse = np.unique(keys, return_inverse=True)
        sums = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.int64)
        rows = [("w", int(blocks[k]), blob, 0, 0) for k, blob in pack(who, len(blobs), keys, sums[inverse])]
        rows.append(("n", 0, b"", int(sums.sum()), int((sums > 0).sum())))
    tidy()
    out = pd.DataFrame(rows, columns=["kind", "block", "blob", "tokens", "words"])
    out.insert(1, "p", p)
    return out


def _short_grams(grams_by_part: DataFrame, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last ``near`` bytes (two at most) of all grams."""

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 8 * near, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                (keys,), (sums,) = _unpack_sorted([blob], "<u8", "<i8")
                np.add.at(total, (keys & np.uint64(len(total) - 1)).astype(np.int64), sums)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    found = grams_by_part.select("blob").mapInArrow(shorten, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    return found["code"].to_numpy(np.uint64), found["n"].to_numpy(np.int64)


def _hot_contexts(grams_by_part: DataFrame, order: int, near: int, most: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length (``near`` bytes and more), the contexts with more than ``most`` n-grams, and codes and counts of these with their next byte.

    A length is looked at only below what is hot at the one before.
    """
    spark, out, above = grams_by_part.sparkSession, {}, None
    for d in range(near, order):
        held = spark.sparkContext.broadcast(above)

        def tell(batches: Iterator[pa.RecordBatch], d=d, held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    (keys,), (sums,) = _unpack_sorted([blob], "<u8", "<i8")
                    contexts = keys >> np.uint64(8)
                    if held.value is not None:
                        some = np.isin(_ends(contexts, d - 1), held.value)
                        keys, sums, contexts = keys[some], sums[some], contexts[some]
                    found, n = np.unique(_ends(contexts, d), return_counts=True)
                    # counts of what follows a context: those of the length before, now that its contexts are known
                    codes, total = _sum(_ends(keys, d), sums) if held.value is not None else (keys[:0], sums[:0])
                    kind = np.r_[np.zeros(len(found), np.int32), np.ones(len(codes), np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.r_[found, codes].view(np.int64)), pa.array(np.r_[n, total].astype(np.int64))], names=["kind", "code", "n"])

        sums = grams_by_part.select("blob").mapInArrow(tell, "kind int, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))
        told = sums.where(((F.col("kind") == 0) & (F.col("n") > most)) | ((F.col("kind") == 1) & (F.col("n") > 0))).orderBy("code").toArrow()
        kind, code, n = told.column("kind").to_numpy(), told.column("code").to_numpy().view(np.uint64), told.column("n").to_numpy()
        if above is not None:
            out[d - 1] = (above, code[kind == 1], n[kind == 1])
        above = code[kind == 0]
        if not len(above):
            return out
    # the last length's contexts have 256 n-grams at most; none is hot unless a task is to hold fewer
    codes = _followers(grams_by_part, order - 1, above) if above is not None else None
    if codes is not None:
        out[order - 1] = (above, *codes)
    return out


def _followers(grams_by_part: DataFrame, d: int, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of contexts of ``d`` bytes with their next one."""
    held = grams_by_part.sparkSession.sparkContext.broadcast(contexts)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                (keys,), (sums,) = _unpack_sorted([blob], "<u8", "<i8")
                some = np.isin(_ends(keys >> np.uint64(8), d), held.value)
                codes, total = _sum(_ends(keys[some], d + 1), sums[some])
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(total.astype(np.int64))], names=["code", "n"])

    told = grams_by_part.select("blob").mapInArrow(tell, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where("n > 0").orderBy("code").toArrow()
    return told.column("code").to_numpy().view(np.uint64), told.column("n").to_numpy()


def _dealt_by(keys: np.ndarray, order: int, near: int, hot: dict[int, tuple]) -> np.ndarray:
    """What an n-gram is dealt by: the last bytes of its context, one more than where they are hot, and how many."""
    contexts = keys >> np.uint64(8)
    depth = np.full(len(keys), near, np.uint64)
    for d in sorted(hot):
        depth[(depth == d) & np.isin(_ends(contexts, d), hot[d][0])] += np.uint64(1)
    return (contexts & ((np.uint64(1) << np.uint64(8) * depth) - np.uint64(1))) ^ (depth << np.uint64(56))


def _prices(grams_by_part: DataFrame, order: int, count: int, tasks: int, most: int) -> DataFrame:
    """Each distinct gram with its log10 probability, packed, by the partition (p) that counted it; ``most`` n-grams of a context stay together."""
    near = min(NEAR, order)
    spark = grams_by_part.sparkSession
    short = spark.sparkContext.broadcast(_short_grams(grams_by_part, near) if near else None)
    hot = spark.sparkContext.broadcast(_hot_contexts(grams_by_part, order, near, most) if near else {})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                (keys,), (sums,) = _unpack_sorted([blob], "<u8", "<i8")
                rows = _pack_sorted(_home(_dealt_by(keys, order, near, hot.value), tasks), tasks, keys, sums)
                yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["q", "blob"])

    def price(group: pd.DataFrame) -> pd.DataFrame:
        keys, sums = map(np.concatenate, _unpack_sorted(list(group["blob"]), "<u8", "<i8"))
        by = np.argsort(keys)
        keys, sums = keys[by], sums[by]
        learnt = sums > 0
        logs = Trie(keys[learnt], sums[learnt], order, near, short.value, hot.value, keys).log10(keys).astype(np.float32)
        rows = _pack_sorted(_home(keys, count), count, keys, logs)
        tidy()
        return pd.DataFrame({"p": [p for p, _ in rows], "blob": [b for _, b in rows]})

    by_context = dealt(grams_by_part.select("blob").mapInArrow(deal, "q bigint, blob binary"), tasks, "q")
    return by_context.groupBy("q").applyInPandas(price, "p bigint, blob binary")


def _answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """For each block the prices of its own grams in one partition."""
    keys, logs = map(np.concatenate, _unpack_sorted(list(left["blob"]), "<u8", "<f4"))
    by = np.argsort(keys)
    keys, logs = keys[by], logs[by]
    out = []
    for blob in right["blob"]:
        at = np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint32), dtype=np.uint32)
        out += [b for _, b in _pack_sorted(np.zeros(len(at), np.int64), 1, keys[at], logs[at])]
    tidy()
    return pd.DataFrame({"kind": "g", "block": right["block"].to_numpy(), "blob": out})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_nodes: int = MAX_NODES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    The model and the base learn from rows whose crc32 of the id as text,
    modulo 7, isn't 2.  A null text is empty: one token, its end.  A null id
    is hashed as the empty text.  Rows with one id are scored each and count
    each; other columns are left out, so none can clash.  An empty table
    gives an empty result; without training rows every byte of the model is
    as likely as any other.  ``max_nodes`` sets how many n-grams a task gives
    their probabilities, about; no score depends on it.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    try:
        blocks, size = _blocks(docs, id_col, text_col)
    except AnalysisException:  # rows of no file: as a table they have one
        blocks, size = _blocks(materialise(docs, "ppm-docs"), id_col, text_col)
    count = partitions(spark, size, PART_BYTES)
    shape = "kind string, p bigint, block bigint, blob binary, tokens bigint, words bigint"
    counted = materialise(dealt(_gather(blocks, order, count), 2 * count, "kind", "p").groupBy("kind", "p").applyInPandas(_reduce, shape), "ppm-counts")
    distinct_grams = counted.where("kind = 'g'").agg(F.sum("words")).first()[0] or 0
    prices = materialise(_prices(counted.where("kind = 'g'"), order, count, partitions(spark, distinct_grams, max_nodes), max(max_nodes, distinct_grams // HOT)), "ppm-prices")
    tokens, distinct = counted.where("kind = 'n'").agg(F.sum("tokens"), F.sum("words")).first()
    n, v = tokens or 0, distinct or 0
    asked = dealt(counted.where("kind = 'i'").select("p", "block", "blob"), count, "p")
    answers = dealt(prices, count, "p").groupBy("p").cogroup(asked.groupBy("p")).applyInPandas(_answer, "kind string, block bigint, blob binary")
    own = counted.where("kind = 'w'").select("kind", "block", "blob").union(answers)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        held = list(zip(right.column("kind").to_pylist(), right.column("blob").to_pylist(), strict=True))
        keys, counts = unpack([b for k, b in held if k == "w"], "<u8", "<i8")
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        logs = np.log10((counts + 1) / (n + v + 1))
        end = np.searchsorted(keys, END_TOKEN)
        model, out = Prices(*map(np.concatenate, _unpack_sorted([b for k, b in held if k == "g"], "<u8", "<f4")), order), []
        for batch in left.select(["body", "id", "held"]).to_batches():
            for piece in pieces(batch, 1 << 20):
                data, offsets = buffers(piece.column(0))
                hashes, _, _, first = word_hashes(data, offsets)
                at = np.searchsorted(keys, hashes)
                some, sums = np.diff(first) > 0, np.zeros(len(first) - 1)
                if some.any():
                    sums[some] = np.add.reduceat(logs[at], first[:-1][some])
                known = np.r_[0, np.cumsum(counts[at] > 0)]
                columns = [
                    piece.column(1),
                    piece.column(2),
                    pa.array(np.diff(first) + 1),
                    pa.array(known[first[1:]] - known[first[:-1]] + int(counts[end] > 0)),
                    pa.array(sums + logs[end]),
                    pa.array(model.score(data, offsets)),
                ]
                out.append(pa.RecordBatch.from_arrays(columns, names=["id", "held", "n_tokens", "n_known", "base_score", "score"]))
        tidy()
        return pa.Table.from_batches(out)

    shape = "id string, held boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    each = partitions(spark, size, BLOCK_BYTES)
    left = dealt(blocks.select("id", "body", "held", "block"), each, "block")
    scored = left.groupBy("block").cogroup(dealt(own, each, "block").groupBy("block")).applyInArrow(score, shape)
    return scored.select(F.col("id").cast(kind).alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op6_ppm_scores(spark, sf_dir) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
