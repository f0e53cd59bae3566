"""Near duplicates by SetSketch registers: banded, estimated by likelihood, verified.

Each element of a set has an exponentially distributed value for every
register; a register keeps the least of them as an exponentially spaced
integer, ``floor(1 - log_b(min))``, truncated to 16 bits.  Sketches of parts
merge into the union's by the larger registers.  Two sets' registers are equal
with a probability that grows with their similarity: classes of equal sets
meet in the inverted lists of their bands of registers.

In each list one leader is compared with the others: the class whose bands
stand in the most and longest lists, which in a group of near copies is their
origin.  For each pair the likelihood of all registers, given the sets' sizes,
is maximised over the similarity; a pair is left out only if the threshold
itself is less likely than the best by ``exp(MARGIN)``.  The others are
verified on their full sets.  Links become components; pairs of one list whose
classes are then still in different components are compared in cells of a
bounded size, in the same two steps, a pair only in the list of the first band
that it shares and only while it would join two components.

Lists, leaders and pairs are joins and aggregations whose keys Spark combines
before the shuffle or splits when they are skewed; sets meet in blocks of one
class and up to ``BLOCK`` partners.  Only a filter of classes (8 MB) is
broadcast.  A pair at the threshold shares no band once in 10^6 pairs, one of
similarity 0.9 once in 10^9.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .ngram_join import _cells, shingle_sets
from .shared import Scratch, dealt, key_filter, materialise, partitions, passes, pieces, small_batches, tidy

WIDTH = 3
#: Similarity in hundredths.
PERCENT = 85
BANDS, ROWS = 24, 5
#: Spacing of the registers' values, and the rate of the elements' ones.
BASE, RATE = 1.001, 20.0
#: Logarithm of how much less likely the threshold may be than the best similarity.
MARGIN = 18.0
#: Partners of a class in one block of the verification.
BLOCK = 64
#: Shingles of a task in the verification.
TASK_TOKENS = 2_000_000
CELL = 256

_RANDOM = np.random.Generator(np.random.PCG64(13))
_SHIFT = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_SCALE = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of many sets of 64-bit hashes, one row each; an empty set has zeros."""
    out = np.zeros((len(sets), BANDS * ROWS), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    tokens = np.concatenate([sets[i] for i in some])
    starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
    least = np.empty((len(some), BANDS * ROWS))
    for k in range(BANDS * ROWS):
        # the least uniform value has the least exponential one
        x = (tokens ^ _SHIFT[k]) * _SCALE[k]
        least[:, k] = np.minimum.reduceat((x ^ x >> np.uint64(32)) * _SCALE[k - 1], starts)
    value = -np.log1p(-np.minimum((least + 0.5) / 2.0**64, 1 - 2.0**-53)) / RATE
    out[some] = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype(np.uint16)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sketched sets."""
    return np.maximum(a, b)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def _log_likelihood(more, less, same, u, v, j):
    """Of a similarity, given how many registers of the first sketch are larger, smaller and equal, and the sizes' shares u and v."""
    p, q = (np.maximum(_share(np.maximum(x, 0)), 1e-12) for x in (u - v * j, v - u * j))
    return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))


def jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 200) -> np.ndarray:
    """Maximum likelihood estimates of the similarity of pairs of sketches (rows of a and b) of sets of na and nb elements."""
    return _profile(a, b, na, nb, steps)[0]


def _profile(a, b, na, nb, steps: int = 64, percent: int | None = None):
    counts = [(a > b).sum(1), (a < b).sum(1), (a == b).sum(1)]
    u = na / (na + nb)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = top[:, None] * np.linspace(0, 1, steps + 1)[None, :]
    chance = _log_likelihood(*(c[:, None] for c in counts), u[:, None], v[:, None], grid)
    at = chance.argmax(1)
    rows = np.arange(len(u))
    goal = None if percent is None else _log_likelihood(*counts, u, v, np.minimum(percent / 100, top))
    return grid[rows, at], chance[rows, at], goal


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sketches whose sets may be as similar as ``percent``: those for which the joint likelihood doesn't rule it out."""
    best, chance, goal = _profile(a, b, na, nb, percent=percent)
    return (best * 100 >= percent) | (chance - goal <= MARGIN)


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits of a set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _survey(docs: DataFrame, width: int) -> DataFrame:
    """id, n, key of every row, and the sketch of each set that its task hasn't met before."""
    kind = docs.schema["id"].dataType.simpleString()

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                sets = shingle_sets(part.column(1), width)
                keys = [set_key(s) if len(s) else None for s in sets]
                fresh = []
                for i, key in enumerate(keys):
                    if key is not None and key not in seen:
                        fresh.append(i)
                        if len(seen) < 500_000:
                            seen.add(key)
                sketches: list[bytes | None] = [None] * len(sets)
                for i, row in zip(fresh, registers([sets[i] for i in fresh]), strict=True):
                    sketches[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "n", "key", "sketch"])
        tidy()

    return docs.mapInArrow(survey, f"id {kind}, n bigint, key binary, sketch binary")


def _bands(classes: DataFrame) -> DataFrame:
    """A row for each class and band: h (band and its registers), band, cid, n."""
    size = 2 * ROWS
    each = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 1 + size * i, size)) for i in range(BANDS)))
    return classes.select("cid", "n", F.posexplode(each).alias("band", "h"))


def _lists(classes: DataFrame) -> DataFrame:
    """Bands of more than one class; of those with the same classes, one (h), with the bands that it stands for as bits and how many members they have."""
    sums = _bands(classes).groupBy("h").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y"))
    bit = F.expr("shiftleft(1L, band)")
    return sums.where("m > 1").groupBy("m", "x", "y").agg(F.min("h").alias("h"), F.bit_or(bit).alias("bands"), F.count(F.lit(1)).alias("often")).select("h", "m", "bands", (F.col("m") * F.col("often")).alias("mass"))


def _near(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _with_leaders(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each list's members with its leader: the class with the most members of lists beside it."""
    mass = members.groupBy("cid").agg(F.sum("mass").alias("weight"))
    led = members.join(mass, "cid").groupBy("h").agg(F.max(F.struct("weight", "cid", "n")).alias("l")).select("h", F.col("l.cid").alias("lead"), F.col("l.n").alias("lead_n"))
    both = members.join(led, "h").where((F.col("cid") != F.col("lead")) & _near(F.col("n"), F.col("lead_n"), percent))
    first = F.col("cid") < F.col("lead")
    a, b, na, nb = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in (("cid", "lead"), ("lead", "cid"), ("n", "lead_n"), ("lead_n", "n")))
    return both.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb")).distinct()


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that their sketches' joint likelihood doesn't rule out."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (4, 5))
                ok = may_reach(left, right, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
                yield batch.filter(pa.array(ok)).select([0, 1, 2, 3])

    sketches = classes.select("cid", "sketch")
    both = pairs.join(sketches.withColumnsRenamed({"cid": "a", "sketch": "left"}), "a").join(sketches.withColumnsRenamed({"cid": "b", "sketch": "right"}), "b")
    return both.select("a", "b", "na", "nb", "left", "right").mapInArrow(estimate, "a bigint, b bigint, na bigint, nb bigint")


def _sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """cid and tokens (its sorted set) of classes (cid, key), once each."""
    wanted = classes.select("cid", "key")
    needed = docs.sparkSession.sparkContext.broadcast(key_filter(wanted.select(F.xxhash64("key"))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                rows = []
                for tokens in shingle_sets(part.column(0), width):
                    if len(tokens) and (key := set_key(tokens)) not in seen:
                        if len(seen) < 500_000:
                            seen.add(key)
                        rows.append((key, tokens.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.binary())], names=["key", "tokens"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(needed.value, batch.column(2).to_numpy()))).select([0, 1])

    found = docs.select("body").mapInArrow(sets, "key binary, tokens binary").select("key", "tokens", F.xxhash64("key").alias("k")).mapInArrow(asked, "key binary, tokens binary")
    return wanted.hint("merge").join(found.dropDuplicates(["key"]), "key").select("cid", "tokens")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, work: Scratch, width: int, percent: int) -> DataFrame:
    """Links (a, b): pairs whose full sets are similar enough."""
    spark = docs.sparkSession
    total = pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0
    if not total:
        return pairs.select("a", "b").limit(0)
    groups = partitions(spark, float(total), TASK_TOKENS)
    # a class with many partners meets them in blocks
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("blocks"))), F.lit(groups))
    placed = work.write(pairs.join(many, "a").select("a", "b", "na", "nb", block.alias("p")), "sketch-blocks")
    routes = placed.select(F.col("a").alias("cid"), F.col("p").alias("q")).union(placed.select("b", "p")).distinct()
    found = _sets(docs, classes.join(routes.select("cid").distinct(), "cid", "left_semi"), width)
    sent = routes.hint("merge").join(found, "cid").select("q", "cid", "tokens")
    sent, placed = dealt(sent, groups, "q"), dealt(placed, groups, "p")

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = {c: np.frombuffer(t, np.uint64) for c, t in zip(left["cid"], left["tokens"], strict=True)}
        a, b = right["a"].to_numpy(), right["b"].to_numpy()
        both = np.array([len(np.intersect1d(held[x], held[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
        union = right["na"].to_numpy() + right["nb"].to_numpy() - both
        ok = both * 100 >= union * percent
        tidy()
        return pd.DataFrame({"a": a[ok], "b": b[ok]})

    return sent.groupBy("q").cogroup(placed.groupBy("p")).applyInPandas(count, "a bigint, b bigint")


def _across(docs: DataFrame, classes: DataFrame, placed: DataFrame, runs: DataFrame, work: Scratch, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components, among the members of two cells (runs: name, x, y, bands) that their sketches don't rule out.

    Each pair of cells gives no more links than it has members.
    """
    members = placed.select("key").distinct().withColumnRenamed("key", "cid")
    whole = classes.join(members, "cid", "left_semi")
    whole = work.write(whole.select("cid", "sketch").join(_sets(docs, whole, width), "cid").withColumnRenamed("cid", "key"), "sketch-sets")
    columns = ("name", "x", "y", "bands", "key", "n", "root")
    left = placed.withColumnRenamed("cell", "x").join(runs, ["name", "x"]).select(*columns, F.lit(0).alias("side"))
    right = placed.withColumnRenamed("cell", "y").join(runs.where("x <> y"), ["name", "y"]).select(*columns, F.lit(1).alias("side"))
    both = work.write(left.union(right), "sketch-copies")
    count = partitions(docs.sparkSession, float(both.agg(F.sum("n")).first()[0] or 0), TASK_TOKENS)
    both = both.withColumn("p", F.pmod(F.xxhash64("name", "x", "y"), F.lit(count))).join(whole, "key")

    def cross(group: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        for (_, x, y), one in group.sort_values(["name", "x", "y", "side"], kind="stable").groupby(["name", "x", "y"], sort=False):
            key, n, root, side = (one[c].to_numpy() for c in ("key", "n", "root", "side"))
            sketch = np.frombuffer(b"".join(one["sketch"]), np.uint16).reshape(len(one), -1)
            tokens, bands = [np.frombuffer(t, np.uint64) for t in one["tokens"]], int(one["bands"].iloc[0])
            above = {r: r for r in root.tolist()}

            def top(r: int) -> int:
                while above[r] != r:
                    above[r] = r = above[above[r]]
                return r

            same, cut = x == y, int((side == 0).sum())
            rows, others = (np.arange(len(one)),) * 2 if same else (np.arange(cut), np.arange(cut, len(one)))
            for r in rows.tolist():
                ok = (root[r] != root[others]) & (np.minimum(n[r], n[others]) * 100 >= np.maximum(n[r], n[others]) * percent)
                if same:
                    ok &= key[r] < key[others]
                to = others[ok]
                if not len(to):
                    continue
                equal = sketch[r] == sketch[to]
                first = equal.reshape(len(to), BANDS, ROWS).all(2).argmax(1)
                mine = (bands >> first & 1).astype(bool)
                to, equal = to[mine], equal[mine].sum(1)
                if not len(to):
                    continue
                reach = may_reach(np.broadcast_to(sketch[r], (len(to), sketch.shape[1])), sketch[to], np.full(len(to), n[r]), n[to], percent)
                for j in to[reach][np.argsort(-equal[reach], kind="stable")].tolist():
                    if top(int(root[r])) != top(int(root[j])):
                        shared = len(np.intersect1d(tokens[r], tokens[j], assume_unique=True))
                        if shared * 100 >= (n[r] + n[j] - shared) * percent:
                            links.append((int(key[r]), int(key[j])))
                            above[top(int(root[j]))] = top(int(root[r]))
        tidy()
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return dealt(both, count, "p").groupBy("p").applyInPandas(cross, "a bigint, b bigint")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, cell: int = CELL) -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the least id reachable by links, its own included) and ``kept`` (its own id is that).

    Words are cut at ASCII white space, A-Z count as a-z.  A text of fewer
    than ``width`` words has its whole sequence as one shingle; a null text or
    one without words has an empty set and is linked with nothing.  Texts with
    equal sets are linked.  Repeated rows count each (and are all kept or
    none); a null id takes part and is never the least unless alone; other
    columns are left out, so none can clash; an empty table gives none.
    Every link is verified on full sets; which pairs are looked at is left to
    the registers, so a pair at the threshold is missed once in 10^6.  Links
    within a component are not enumerated.  ``cell`` sets how work is dealt,
    and changes no result.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    work = Scratch(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"))
    survey = work.write(_survey(rows, width), "sketch-rows")
    classes = survey.where("sketch IS NOT NULL").groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    classes = work.write(classes.withColumn("cid", F.monotonically_increasing_id()), "sketch-classes")
    lists = work.write(_lists(classes), "sketch-lists")
    members = work.write(_bands(classes).join(lists.drop("bands"), "h"), "sketch-members")
    pairs = work.write(_with_leaders(members, percent), "sketch-pairs")
    likely = work.write(_likely(pairs, classes, percent), "sketch-likely")
    links = work.write(_verified(rows, classes, likely, work, width, percent), "sketch-links")
    roots = components(links, work)
    # a list of two has had its only pair
    known = members.where("m > 2").select(F.col("h").alias("name"), F.col("cid").alias("key"), "n", F.lit(0).cast("long").alias("place"))
    known = known.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed, runs = _cells(work.write(known, "sketch-known"), work, percent, cell)
    if not runs.isEmpty():
        runs = runs.join(lists.select(F.col("h").alias("name"), "bands"), "name")
        more = work.write(_across(rows, classes, placed, runs, work, width, percent), "sketch-more")
        roots = components(links.union(more), work)
    roots = classes.select("key", "cid").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").select("key", F.coalesce("root", "cid").alias("root"))
    named = work.write(survey.select("id", "n", "key").join(roots, "key", "left").select("id", "n", "root"), "sketch-named")
    least = materialise(named.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least")), "sketch-least")
    out = named.join(least, "root", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))
    out = materialise(out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))), "sketch")
    work.clear()
    return out


def op13_setsketch(spark, sf_dir) -> DataFrame:
    """Every document's set size, component and whether it stays, as :func:`near_copies` has them."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) c ON c.x = d.doc_id
"""
