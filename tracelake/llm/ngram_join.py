"""Similarity join of documents on word shingles, by vertical partitioning.

A document's set is that of its distinct shingles (64-bit hashes); documents
with equal sets are one class.  All n-grams have one global order: by how many
documents hold their hash bucket, rare ones first.

Candidates: two sets can be similar enough only if their first common n-gram
stands early in both.  Each class sends its prefix to inverted lists; in a
list, pairs that pass the length and position filters are candidates.  In a
list of many classes only pairs with its leader are tried at first, and pairs
of classes that are still in different components later: a large group of
near copies costs a few links each, not all its pairs.  The list of a common
n-gram is dealt in parts by a hash of n-gram and class, each with a leader of
its own; which n-grams are common is counted exactly, among those of prefixes
whose bucket may hold one.  What is left for later is dealt by list, component and length into
cells of a bounded size, and cells are compared two by two; lists within one
component end before that.

Counting: the global order is cut into fragments of equal mass.  The segment
of a set in each fragment goes to that fragment's tasks, which count the
partial overlaps of candidate pairs; partial counts are summed per pair.  The
fragments are as many at any size; tasks also divide by a hash of the pair's
first class, and only classes that a candidate names send their segments.

Links become components by distributed star contraction.  Nothing that grows
with the input is broadcast: the order of the buckets and the filter of needed
classes have fixed sizes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, buffers, dealt, key_filter, materialise, mix, pack, partitions, passes, pieces, small_batches, tidy, unpack, word_hashes

WIDTH = 5
#: Similarity in hundredths.
PERCENT = 80
ORDER_BITS, CHUNK_BITS = 22, 16
FRAGMENTS = 8
#: Lists up to this length give all their pairs at once.
SHORT_LIST = 4
#: Classes that an n-gram's list has before it is dealt in parts of about so many; more where that would make more than ``COMMON`` n-grams common.
HOT = 4096
#: Common n-grams at most (their hashes are broadcast, 12 bytes each).
COMMON = 1 << 20
#: Classes of a long list are compared in cells of about so many.
CELL = 256
#: Tokens of a task in the lists and in the fragments.
TASK_TOKENS = 1_000_000

_ODDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, of all its words."""
    data, offsets = buffers(column)
    words, _, _, first = word_hashes(data, offsets)
    n = len(words)
    sums = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        sums += words[k : k + len(sums)] * _ODDS[k]
    sums = mix(sums)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(sums[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _ODDS[: b - a]).sum()], np.uint64) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _survey(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per document (id, n, key), and packed counts of n-grams by hash bucket (chunk, salt, blob)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << ORDER_BITS, np.int64)
        names = ["id", "n", "key", "chunk", "salt", "blob"]
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for part in pieces(batch, 1 << 20):
                sets = shingle_sets(part.column(1), width)
                if sets:
                    counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts))
                none = pa.nulls(len(sets), pa.int32())
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), none, none, pa.nulls(len(sets), pa.binary())], names=names)
        tidy()
        rows = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(counts.reshape(-1, 1 << CHUNK_BITS)) if c.any()]
        if rows:
            salt = TaskContext.get().partitionId() % 64
            n = len(rows)
            columns = [pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([i for i, _ in rows], pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([b for _, b in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(survey, f"id {kind}, n bigint, key bigint, chunk int, salt int, blob binary")


def _add_chunks(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << CHUNK_BITS, np.int64)
    for blob in group["blob"]:
        total += np.frombuffer(zlib.decompress(blob), np.int64)
    return pd.DataFrame({"chunk": [int(group["chunk"].iloc[0])], "blob": [zlib.compress(total.tobytes(), 1)]})


def _order(chunks: DataFrame, hot: int) -> tuple[np.ndarray, int, np.ndarray, int, int]:
    """Rank of each hash bucket in the global order; of the buckets' n-grams, all, and the ranks that cut them in equal shares; the least count that makes an n-gram common, and the first rank that may hold one."""
    summed = chunks.groupBy("chunk", "salt").applyInPandas(_add_chunks, "chunk int, blob binary").groupBy("chunk").applyInPandas(_add_chunks, "chunk int, blob binary")
    counts = np.zeros((1 << ORDER_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.int64)
    for row in summed.collect():  # 32 MB at most
        counts[row.chunk] = np.frombuffer(zlib.decompress(row.blob), np.int64)
    counts = counts.reshape(-1)
    by = np.argsort(counts, kind="stable")
    rank = np.empty(len(by), np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    # the driver keeps the ranks alone, until they are broadcast
    del by
    counts.sort()
    hot = max(hot, int(counts.sum()) // COMMON)
    first = int(np.searchsorted(counts, hot, "right"))
    mass = np.cumsum(counts, out=counts)
    return rank, int(mass[-1]), np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS), hot, first


def _common(docs: DataFrame, text_col: str, rank, first: int, width: int, percent: int, hot: int) -> DataFrame:
    """tok, n of n-grams in more than ``hot`` prefixes, of those in buckets from rank ``first`` on; a class counts once a task at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = rank.value, set()
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                toks = [np.zeros(0, np.uint64)]
                for tokens in shingle_sets(part.column(0), width):
                    if not len(tokens) or (key := set_key(tokens)) in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(key)
                    head = in_order(tokens, order)[: prefix_length(len(tokens), percent)]
                    # the order is by rank: what may be common stands last
                    at = np.searchsorted(order[(head >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], first)
                    toks.append(head[at:])
                tok, n = np.unique(np.concatenate(toks), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(n.astype(np.int64))], names=["tok", "n"])

    counts = docs.select(F.col(text_col).alias("body")).mapInArrow(count, "tok bigint, n bigint")
    return counts.groupBy("tok").agg(F.sum("n").alias("n")).where(F.col("n") > hot)


def _parts(docs: DataFrame, text_col: str, rank, first: int, width: int, percent: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the common n-grams, ascending, and into how many parts the list of each is dealt."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    if first == 1 << ORDER_BITS:
        return none
    rows = _common(docs, text_col, rank, first, width, percent, hot).toArrow()  # COMMON rows at most: each stands for more than a COMMON-th of all
    if not rows.num_rows:
        return none
    tok, n = rows.column("tok").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    by = np.argsort(tok)
    return tok[by], (-(-n[by] // hot)).astype(np.uint32)


def in_order(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A sorted set in the global order."""
    return tokens[np.argsort(rank[(tokens >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], kind="stable")]


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def may_link(n1, i1, n2, i2, percent: int):
    """Whether sets of these sizes whose first common n-gram stands at these places can be similar enough."""
    need = -(-percent * (n1 + n2) // (100 + percent))
    return (np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent) & (np.minimum(n1 - i1, n2 - i2) >= need)


def _postings(docs: DataFrame, text_col: str, rank, spread, width: int, percent: int, count: int) -> DataFrame:
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, (common, parts), seen = rank.value, spread.value, set()
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                toks, keys, sizes, places = [], [], [], []
                for tokens in shingle_sets(part.column(0), width):
                    n = len(tokens)
                    if not n or (key := set_key(tokens)) in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(key)
                    p = prefix_length(n, percent)
                    toks.append(in_order(tokens, order)[:p])
                    keys.append(key)
                    sizes.append(n)
                    places.append(p)
                if not toks:
                    continue
                tok = np.concatenate(toks)
                lengths = np.array(places)
                key = np.repeat(np.array(keys, np.int64), lengths)
                size = np.repeat(np.array(sizes, np.int32), lengths)
                place = (np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
                # the lists of common n-grams in parts; -1 is a list that is whole
                share = np.full(len(tok), -1, np.int32)
                if len(common):
                    at = np.minimum(np.searchsorted(common, tok), len(common) - 1)
                    dealt_ = common[at] == tok
                    share[dealt_] = mix(tok[dealt_] ^ key[dealt_].view(np.uint64)) % parts[at[dealt_]]
                home = mix(tok ^ (share + 1).astype(np.uint64) * _ODDS[0])
                rows = pack((home % np.uint64(count)).astype(np.int64), count, tok, key, size, place, share)
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["p", "blob"])

    return docs.select(F.col(text_col).alias("body")).mapInArrow(post, "p bigint, blob binary")


def _unique_pairs(a, b, na, nb) -> tuple[np.ndarray, ...]:
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    by = np.lexsort((b, a))
    a, b, na, nb = a[by], b[by], na[by], nb[by]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[first], b[first], na[first], nb[first]


def _lists(percent: int):
    """Of one partition of the inverted lists: candidate pairs, and long lists for later (a: their name)."""

    def lists(group: pd.DataFrame) -> pd.DataFrame:
        tok, key, size, place, share = unpack(list(group["blob"]), "<u8", "<i8", "<i4", "<i4", "<i4")
        by = np.lexsort((key, share, tok))
        tok, key, size, place, share = tok[by], key[by], size[by], place[by], share[by]
        starts = np.r_[True, (tok[1:] != tok[:-1]) | (share[1:] != share[:-1])] if len(tok) else np.zeros(0, bool)
        fresh = starts.copy()
        fresh[1:] |= key[1:] != key[:-1]
        tok, key, size, place, share = tok[fresh], key[fresh], size[fresh].astype(np.int64), place[fresh].astype(np.int64), share[fresh]
        starts = np.flatnonzero(starts[fresh])
        lengths = np.diff(np.r_[starts, len(tok)])
        length, run = np.repeat(lengths, lengths), np.repeat(np.arange(len(starts)), lengths)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, SHORT_LIST):
            i = np.flatnonzero((length[:-d] <= SHORT_LIST) & (run[:-d] == run[d:])) if len(tok) > d else np.zeros(0, np.int64)
            left.append(i)
            right.append(i + d)
        later: dict[bytes, list] = {}
        held: list[tuple] = []
        for s, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            part = share[s] >= 0
            if m <= SHORT_LIST and not part:
                continue
            i = np.arange(s, s + m)
            # whoever has the fewest rarer n-grams of its own is likely the others' origin
            lead = s + int(np.lexsort((key[i], -size[i], place[i]))[0])
            others = i[i != lead]
            if m > SHORT_LIST:
                left.append(np.full(len(others), lead))
                right.append(others)
            if part:  # its leader too has to meet the other parts
                held.append((int(tok[s : s + 1].view(np.int64)[0]), key[i], size[i], place[i]))
                continue
            told = key[others].tobytes()
            if told in later:
                later[told][3] = np.minimum(later[told][3], place[others])
            else:
                name = int.from_bytes(hashlib.blake2b(told, digest_size=8).digest(), "little", signed=True)
                later[told] = [name, key[others], size[others], place[others]]
        i, j = np.concatenate(left), np.concatenate(right)
        ok = may_link(size[i], place[i], size[j], place[j], percent)
        a, b, na, nb = _unique_pairs(key[i[ok]], key[j[ok]], size[i[ok]], size[j[ok]])
        pairs = pd.DataFrame({"a": a, "b": b, "na": na, "nb": nb, "blob": [None] * len(a)})
        for name, k, n, p in later.values():
            some = _some_partner(n, percent)
            if some.any():
                held.append((name, k[some], n[some], p[some]))
        more = pd.DataFrame({"a": [x[0] for x in held], "b": 0, "na": 0, "nb": 0, "blob": [b"".join(c.tobytes() for c in x[1:]) for x in held]}) if held else pairs[:0]
        tidy()
        return pd.concat([pairs, more], ignore_index=True).astype({"a": "int64", "b": "int64", "na": "int64", "nb": "int64"})

    return lists


def _some_partner(n: np.ndarray, percent: int) -> np.ndarray:
    """Members of a list that may link with another one by their lengths: the next shorter or longer one is near enough."""
    by = np.argsort(n, kind="stable")
    near = n[by][:-1] * 100 >= n[by][1:] * percent
    out = np.zeros(len(n), bool)
    out[by[:-1]] |= near
    out[by[1:]] |= near
    return out


def _spread_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of long lists: the list's name, key, n, place."""
    for batch in batches:
        for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            m = len(blob) // 24
            key, n, place = (np.frombuffer(blob, "<i8", m, 8 * m * k) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, name, np.int64)), pa.array(key), pa.array(n), pa.array(place)], names=["name", "key", "n", "place"])


def _cells(known: DataFrame, work: Scratch, percent: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Members (name, key, n, place, root) of lists in several components with their cells, and the pairs of cells (name, x, y) to compare.

    A cell holds about ``cell`` members of one list and one band of lengths:
    of one component if that has more, else of whole components.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    known = known.withColumn("band", band)
    sums = work.write(known.groupBy("name", "root", "band").agg(F.count(F.lit(1)).alias("m")), "join-sums")
    alive = sums.groupBy("name").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("name")
    pools = sums.where(F.col("m") <= cell).groupBy("name", "band").agg(F.ceil(F.sum("m") / cell).alias("pool"))
    plan = sums.join(alive, "name", "left_semi").join(pools, ["name", "band"], "left")
    plan = work.write(plan.select("name", "root", "band", F.when(F.col("m") > cell, F.ceil(F.col("m") / cell)).alias("own"), "pool"), "join-cells")
    alone = F.col("own").isNotNull()
    part = F.when(alone, F.pmod(F.xxhash64("key"), F.col("own"))).otherwise(F.pmod(F.xxhash64("root"), F.col("pool")))
    placed = known.join(plan, ["name", "root", "band"]).withColumn("alone", F.when(alone, F.col("root"))).withColumn("cell", F.xxhash64("band", "alone", part))
    placed = work.write(placed.select("name", "key", "n", "place", "root", "cell", "alone"), "join-placed")
    found = work.write(placed.groupBy("name", "cell").agg(F.min("alone").alias("alone"), F.min("n").alias("lo"), F.max("n").alias("hi")), "join-found")
    a, b = found.alias("a"), found.alias("b")
    other = F.coalesce(F.col("a.alone") != F.col("b.alone"), F.lit(True))
    near = (F.col("a.lo") * percent <= F.col("b.hi") * 100) & (F.col("b.lo") * percent <= F.col("a.hi") * 100)
    pairs = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.cell") <= F.col("b.cell")) & other & near)
    return placed, work.write(pairs.select(F.col("a.name").alias("name"), F.col("a.cell").alias("x"), F.col("b.cell").alias("y")), "join-runs")


def _across(placed: DataFrame, runs: DataFrame, percent: int, count: int) -> DataFrame:
    """Candidate pairs of members of two cells that are in different components."""
    columns = ("name", "x", "y", "key", "n", "place", "root")
    left = placed.withColumnRenamed("cell", "x").join(runs, ["name", "x"]).select(*columns, F.lit(0).alias("side"))
    right = placed.withColumnRenamed("cell", "y").join(runs.where("x <> y"), ["name", "y"]).select(*columns, F.lit(1).alias("side"))
    both = left.union(right).withColumn("p", F.pmod(F.xxhash64("name", "x", "y"), F.lit(count)))
    return dealt(both, count, "p").groupBy("p").applyInPandas(_cross_pairs(percent), "a bigint, b bigint, na bigint, nb bigint")


def _cross_pairs(percent: int):
    def cross(group: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64),) * 4]
        group = group.sort_values(["name", "x", "y", "side"], kind="stable")
        for (_, left, right), one in group.groupby(["name", "x", "y"], sort=False):
            key, n, place, root, side = (one[c].to_numpy() for c in ("key", "n", "place", "root", "side"))
            whole, cut = left == right, int((side == 0).sum())
            rows, columns = (np.arange(len(one)),) * 2 if whole else (np.arange(cut), np.arange(cut, len(one)))
            for a in range(0, len(rows), 512):
                r = rows[a : a + 512]
                ok = may_link(n[r, None], place[r, None], n[None, columns], place[None, columns], percent) & (root[r, None] != root[None, columns]) & (key[r, None] < key[None, columns] if whole else True)
                x, y = np.nonzero(ok)
                found.append((key[r[x]], key[columns[y]], n[r[x]], n[columns[y]]))
        a, b, na, nb = _unique_pairs(*(np.concatenate(c) for c in zip(*found, strict=True)))
        return pd.DataFrame({"a": a, "b": b, "na": na, "nb": nb})

    return cross


def _overlaps(docs: DataFrame, text_col: str, pairs: DataFrame, rank, cuts: np.ndarray, width: int, percent: int, work: Scratch) -> DataFrame:
    """Links (a, b) among candidate pairs (a, b, na, nb): partial overlaps by fragment, summed per pair."""
    total = pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0
    if not total:
        return pairs.select("a", "b").limit(0)
    groups = int(max(1, -(-total // (FRAGMENTS * 2 * TASK_TOKENS))))
    h = F.pmod(F.xxhash64("a"), F.lit(groups))
    routes = pairs.select(F.col("a").alias("key"), h.alias("h")).union(pairs.select("b", h)).distinct()
    needed = work.broadcast(key_filter(routes.select("key").distinct()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits = set(), needed.value
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                rows = []
                for tokens in shingle_sets(part.column(0), width):
                    if len(tokens) and (key := set_key(tokens)) not in seen and passes(bits, np.array([key]))[0]:
                        if len(seen) < 500_000:
                            seen.add(key)
                        rows.append((key, tokens.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], names=["key", "tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = rank.value
        for batch in batches:
            parts: dict[tuple[int, int], list[list]] = {}
            for key, where, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tokens = np.frombuffer(blob, np.uint64)
                f = np.searchsorted(cuts, order[(tokens >> np.uint64(64 - ORDER_BITS)).astype(np.int64)], "right")
                for k in np.unique(f).tolist():
                    held = parts.setdefault((k, where), [[], [], []])
                    segment = tokens[f == k]
                    held[0].append(key)
                    held[1].append(len(segment))
                    held[2].append(segment)
            if parts:
                columns = [
                    pa.array([k for k, _ in parts], pa.int32()),
                    pa.array([w for _, w in parts], pa.int64()),
                    pa.array([np.array(x[0], np.int64).tobytes() for x in parts.values()], pa.binary()),
                    pa.array([np.array(x[1], np.int64).tobytes() for x in parts.values()], pa.binary()),
                    pa.array([np.concatenate(x[2]).tobytes() for x in parts.values()], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["f", "h", "keys", "lengths", "tokens"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, where = (batch.column(i).to_numpy() for i in range(3))
            for k, blob in pack(where, groups, a, b):
                yield pa.RecordBatch.from_arrays([pa.array(range(FRAGMENTS), pa.int32()), pa.array([k] * FRAGMENTS, pa.int64()), pa.array([blob] * FRAGMENTS, pa.binary())], names=["f", "h", "blob"])

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return none
        key, length = (np.concatenate([np.frombuffer(x, np.int64) for x in left[c]]) for c in ("keys", "lengths"))
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in left["tokens"]])
        begin = np.cumsum(length) - length
        # a class that several tasks have sent counts once
        known, first = np.unique(key, return_index=True)
        begin, length = begin[first], length[first]
        a, b = unpack(list(right["blob"]), "<i8", "<i8")
        if not len(a):
            return none
        ia, ib = (np.minimum(np.searchsorted(known, x), len(known) - 1) for x in (a, b))
        both = (known[ia] == a) & (known[ib] == b)
        a, b, ia, ib = a[both], b[both], ia[both], ib[both]
        _, small = np.unique(tokens, return_inverse=True)
        where = np.repeat(np.arange(len(known)), length)
        picked = np.repeat(begin, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        held = np.sort(where << 32 | small[picked])
        out = np.zeros(len(a), np.int64)
        # look the shorter segment up in the longer one, some millions of n-grams at once
        swap = length[ia] > length[ib]
        ask_, of = np.where(swap, ib, ia), np.where(swap, ia, ib)
        ends = np.cumsum(length[ask_])
        at = 0
        while at < len(a):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000)))
            n = length[ask_[at:stop]]
            pair = np.repeat(np.arange(at, stop), n)
            i = np.repeat(begin[ask_[at:stop]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wanted = of[pair] << 32 | small[i]
            hit = held[np.minimum(np.searchsorted(held, wanted), len(held) - 1)] == wanted
            out += np.bincount(pair[hit], minlength=len(a))
            at = stop
        some = out > 0
        tidy()
        return pd.DataFrame({"a": a[some], "b": b[some], "n": out[some]})

    found = docs.select(F.col(text_col).alias("body")).mapInArrow(sets, "key bigint, tokens binary")
    # the sets are shuffled at any size, so that a small run is planned like a large one
    segments = routes.hint("merge").join(found, "key").select("key", "h", "tokens").mapInArrow(cut, "f int, h bigint, keys binary, lengths binary, tokens binary")
    asked = pairs.select("a", "b", h.alias("h")).mapInArrow(ask, "f int, h bigint, blob binary")
    segments, asked = (dealt(x, groups * FRAGMENTS, "f", "h") for x in (segments, asked))
    partial = segments.groupBy("f", "h").cogroup(asked.groupBy("f", "h")).applyInPandas(count, "a bigint, b bigint, n bigint")
    summed = partial.groupBy("a", "b").agg(F.sum("n").alias("n"))
    sizes = pairs.select("a", "b", (F.col("na") + F.col("nb")).alias("size"))
    return summed.join(sizes, ["a", "b"]).where(F.col("n") * (100 + percent) >= F.col("size") * percent).select("a", "b")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the least id reachable by links, its own included).

    Words are cut at ASCII white space, A-Z count as a-z.  A text of fewer
    than ``width`` words has its whole sequence as one shingle; a null text or
    one without words has an empty set and is linked with nothing.  Texts with
    equal sets are linked.  Repeated rows count each; a null id takes part and
    is never the least unless alone; other columns are left out, so none can
    clash; an empty table gives an empty result.  Links within a component are
    not enumerated: pairs of a long list that are in one component already are
    never counted.  ``hot`` and ``cell`` set how work is dealt, and change no
    result.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    work = Scratch(spark)
    docs = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(text_col))
    survey = work.write(_survey(docs, id_col, text_col, width), "join-survey")
    rows = survey.where("chunk IS NULL").select("id", "n", "key")
    order, total, cuts, hot, first = _order(survey.where("chunk IS NOT NULL").select("chunk", "salt", "blob"), hot)
    rank = work.broadcast(order)
    del order
    spread = work.broadcast(_parts(docs, text_col, rank, first, width, percent, hot))
    count = partitions(spark, float(total) * (100 - percent) / 100, TASK_TOKENS)
    lists = _postings(docs, text_col, rank, spread, width, percent, count).repartition(count, "p").groupBy("p")
    candidates = work.write(lists.applyInPandas(_lists(percent), "a bigint, b bigint, na bigint, nb bigint, blob binary"), "join-lists")
    pairs = work.write(candidates.where("blob IS NULL").select("a", "b", "na", "nb").distinct(), "join-pairs")
    links = work.write(_overlaps(docs, text_col, pairs, rank, cuts, width, percent, work), "join-links")
    later = candidates.where("blob IS NOT NULL").select("a", "blob").distinct()
    roots = components(links, work)
    if not later.isEmpty():
        members = later.mapInArrow(_spread_lists, "name bigint, key bigint, n bigint, place bigint")
        known = members.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        placed, runs = _cells(work.write(known, "join-members"), work, percent, cell)
        if not runs.isEmpty():
            # what has been counted before needs no second look
            more = _across(placed, runs, percent, count).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
            more = work.write(more, "join-more")
            if not more.isEmpty():
                roots = components(links.union(_overlaps(docs, text_col, more, rank, cuts, width, percent, work)), work)
    named = rows.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("id", "n", F.coalesce("root", "key").alias("root"))
    named = materialise(named, "join-named")
    # a table of its own, so that Spark can split the rows of a large component in the join
    least = materialise(named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")), "join-least")
    work.clear()
    out = named.join(least, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of the least id of each component; all columns as they are.

    Rows with one id stay or go together: they stay if any of them does.
    Nulls, empty texts and empty tables are treated as in :func:`similar_sets`.
    """
    found = similar_sets(docs, id_col, text_col, width, percent)
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id"))
    return docs.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left_semi")


def op4_ngram_join(spark, sf_dir) -> DataFrame:
    return similar_sets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) c ON c.x = d.doc_id
"""
