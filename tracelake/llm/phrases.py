"""Phrase collocations from generalised suffix automata of shards.

A shard is some megabytes of texts.  Its automaton, bounded to phrases of
``DEPTH`` words, is the tree of its suffix links: a node at depth d is a string
of d words, its link the string without its first word, its endpos count the
number of places where it ends; strings of one endpos set are one state.  The
tree is made by sorting the hashes of the words up to each place, depth by
depth, which gives the nodes, links and counts of the online construction in
arrays.

Counts of nodes are summed over the shards.  A node is entered only if the
sums of its link and of its prefix reach the least count, so the texts are
read three times: for words and pairs, for longer phrases all whose pairs are
frequent, and for the words of those that are.  With its count each node gives
a place of its own, a hash of the document's words and of the position in it;
the least place of each is the only one whose words are read, so a phrase
that stands in every shard is sent once.  What a shard looks at is told by
filters of hashes (8 MB); they may let more through, never less.  With far
more than 60 million frequent pairs they let most through, and more counts
are shuffled.  Phrases are told apart by 64-bit hashes.

Cuts and subsumption are joins on language and phrase.  A phrase lies in a
longer one of at least as many occurrences only if it is the link or the
prefix of a candidate that is one word longer, for occurrences fall with
length; so two rows per candidate decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, buffers, key_filter, materialise, mix, passes, pieces, small_batches, tidy, word_hashes

DEPTH = 5
LEAST = 100
TOP = 2000
#: Occurrences of a longer phrase in hundredths of a phrase's own that make it redundant.
PERCENT = 100
#: Bytes of texts of one automaton, and of those hashed at once.
SHARD_BYTES, HASH_BYTES = 8 << 20, 1 << 20
#: Parts of a language that are ranked on their own first.
PARTS = 64

_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _PIECE_ENDS.copy()
_GAP[[9, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Nodes of the suffix-link tree of many word sequences, to a bounded depth.

    ``words`` are hashes and ``sequence`` numbers what they stand in, in order.
    ``key[i]`` is the hash of the last words up to place i at the current
    depth, ``ok[i]`` whether so many words of its sequence stand there.
    """

    def __init__(self, words: np.ndarray, sequence: np.ndarray):
        self.words, self.depth = words, 1
        self.follows = np.zeros(len(words), bool)
        self.follows[1:] = sequence[1:] == sequence[:-1]
        self.key, self.ok = words.copy(), np.ones(len(words), bool)

    def keep(self, known: np.ndarray) -> None:
        """Leave out the places whose node is not in ``known`` (a mask by place)."""
        self.ok = self.ok & known

    def deepen(self) -> None:
        """Go on to strings of one word more whose link and prefix are left."""
        key, ok = np.zeros_like(self.key), np.zeros_like(self.ok)
        key[1:] = mix(self.key[:-1] * _STEP + self.words[1:])
        ok[1:] = self.ok[:-1] & self.follows[1:]
        # at depth 1 the link is the word itself
        ok &= self.ok
        self.key, self.ok, self.depth = key, ok, self.depth + 1

    def nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """A place of each node at this depth, and its endpos count."""
        at = np.flatnonzero(self.ok)
        _, first, count = np.unique(self.key[at], return_index=True, return_counts=True)
        return at[first], count


class _Shard:
    """Words of some texts: their hashes, sequences, languages and names of their places, and where their bytes are."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.names: list[str] = []
        words, sequence, lang, start, end, places, raw, at, gone = [], [], [], [], [], [], [], 0, 0
        for part in parts:
            langs = part.column(0).dictionary_encode()
            to = []
            for name in langs.dictionary.to_pylist():
                if name not in self.names:
                    self.names.append(name)
                to.append(self.names.index(name))
            data, offsets = buffers(part.column(1))
            hashes, a, b, first = word_hashes(data, offsets, space=_GAP)
            text = np.repeat(np.arange(part.num_rows), np.diff(first))
            of = np.array(to, np.int32)[langs.indices.to_numpy()][text]
            place = np.arange(len(hashes)) - first[text] if len(hashes) else text
            # a name for the document's words, and of each place in it
            each = mix(hashes + mix(place.astype(np.uint64) + _STEP))
            sums = np.r_[np.uint64(0), np.cumsum(each, dtype=np.uint64)]
            own = sums[first[1:]] - sums[first[:-1]]
            places.append(mix(own[text] ^ mix(place.astype(np.uint64))))
            salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.names], np.uint64)
            ends = np.cumsum(_PIECE_ENDS[data], dtype=np.int32)
            words.append(mix(hashes ^ salt[of]))
            # a new text begins a new sequence as well
            sequence.append(ends[a] + text + gone if len(a) else text)
            lang.append(of)
            start.append(a + at)
            end.append(b + at)
            raw.append(data.tobytes())
            at, gone = at + len(data), gone + part.num_rows + (int(ends[-1]) if len(ends) else 0)
        self.words, self.sequence, self.lang, self.start, self.end, self.places = map(np.concatenate, (words, sequence, lang, start, end, places))
        self.raw, self.sizes = b"".join(raw), np.bincount(self.lang, minlength=len(self.names))

    def tree(self) -> SuffixAutomaton:
        return SuffixAutomaton(self.words, self.sequence)


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[_Shard]:
    """Shards of about ``limit`` bytes of texts (lang, body)."""
    held, size = [], 0
    for batch in batches:
        for part in pieces(batch.select([1, 0]), HASH_BYTES):
            held.append(part.select([1, 0]))
            size += part.column(0).nbytes
            if size >= limit:
                yield _Shard(held)
                held, size = [], 0
    if held:
        yield _Shard(held)


def _hash_counts(docs: DataFrame, depths: range, known: np.ndarray | None, limit: int) -> DataFrame:
    """h, n, place of the nodes at these depths in each shard, of those entered; summed, with the least place of each."""
    held = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, limit):
            tree, places = shard.tree(), shard.places.view(np.int64)
            del shard
            while True:
                if tree.depth in depths:
                    at, n = tree.nodes()
                    for a in range(0, len(at), 100_000):
                        part = at[a : a + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(tree.key[part].view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64)), pa.array(places[part])], names=["h", "n", "place"])
                    del at, n
                if tree.depth == depths[-1]:
                    break
                if held is not None and tree.depth == 2:
                    tree.keep(passes(held.value, tree.key))
                tree.deepen()
            tidy()

    return docs.mapInArrow(count, "h bigint, n bigint, place bigint").groupBy("h").agg(F.sum("n").alias("n"), F.min("place").alias("place"))


def _words_of(docs: DataFrame, keys: DataFrame, depth: int, limit: int) -> DataFrame:
    """h, place, lang, phrase, k (its words) at places that ``keys`` (h, place) may name; k = 0 has a shard's number of words of a language as h."""
    known, named = (docs.sparkSession.sparkContext.broadcast(key_filter(keys.select(c))) for c in ("h", "place"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, limit):
            tree, raw = shard.tree(), shard.raw.lower()  # of bytes: A-Z alone
            rows: list[tuple] = [(int(n), 0, x, "", 0) for x, n in zip(shard.names, shard.sizes.tolist(), strict=True)]
            start, end, lang, places = shard.start, shard.end, shard.lang, shard.places.view(np.int64)
            here = passes(named.value, shard.places)
            while True:
                k, full = tree.depth, tree.ok
                tree.keep(passes(known.value, tree.key))
                for i in np.flatnonzero(tree.ok & here).tolist():
                    rows.append((int(tree.key[i : i + 1].view(np.int64)[0]), int(places[i]), shard.names[lang[i]], b" ".join(raw[start[j] : end[j]] for j in range(i - k + 1, i + 1)).decode(), k))
                if k == depth:
                    break
                if k == 1:
                    tree.ok = full
                tree.deepen()
            for a in range(0, len(rows), 100_000):
                part = list(zip(*rows[a : a + 100_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.string()), pa.array(part[3], pa.string()), pa.array(part[4], pa.int32())], names=["h", "place", "lang", "phrase", "k"])
            tidy()

    return docs.mapInArrow(read, "h bigint, place bigint, lang string, phrase string, k int")


def phrase_counts(docs: DataFrame, work: Scratch, depth: int = DEPTH, least: int = LEAST, limit: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of up to ``depth`` words (lang, phrase, k, n), and each language's words (lang, n).  ``docs``: lang, body."""
    pairs = work.write(_hash_counts(docs, range(1, 3), None, limit).where(F.col("n") >= least), "phrase-pairs")
    keys = pairs
    if depth > 2:
        longer = _hash_counts(docs, range(3, depth + 1), key_filter(pairs.select("h")), limit)
        keys = pairs.union(work.write(longer.where(F.col("n") >= least), "phrase-longer"))
    told = work.write(_words_of(docs, keys, depth, limit), "phrase-words")
    found = told.where("k > 0").dropDuplicates(["h", "place"]).join(keys, ["h", "place"]).select("lang", "phrase", "k", "n")
    return work.write(found, "phrase-counts"), told.where("k = 0").groupBy("lang").agg(F.sum("h").alias("n"))


def _part(first: bool):
    """A phrase without its first or last word."""
    words = F.split("phrase", " ")
    return F.array_join(F.slice(words, 2 if first else 1, F.col("k") - 1), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = DEPTH, least: int = LEAST, percent: int = PERCENT, limit: int = SHARD_BYTES) -> DataFrame:
    """Phrases of 2 to ``depth`` words that occur ``least`` times and lie in no longer candidate of ``percent`` hundredths of their occurrences.

    Per language (null: ``und``): lang, phrase, k (words), a (occurrences), l
    and r (those of the two sides of its lowest-scoring cut), n (the
    language's words) and score, ``floor(1000 * a * n / (l * r))`` in exact
    arithmetic.  A-Z count as a-z; texts are split at ``.,;:!?`` and line ends
    into pieces, and these at spaces and tabs.  Null and empty texts have no
    words; repeated rows count each; other columns are left out, so none can
    clash; an empty table gives none.  ``limit`` sets the size of a shard, and
    changes no result.
    """
    small_batches(docs.sparkSession)
    work = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("body"))
    found, sizes = phrase_counts(rows, work, depth, least, limit)
    several = found.where("k > 1")
    longer = several.where("k > 2").select("lang", F.explode(F.array(_part(True), _part(False))).alias("phrase"), F.col("n").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = several.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * percent))
    words = F.split("phrase", " ")
    cut = left.select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.withColumns({"head": F.array_join(F.slice(words, 1, F.col("cut")), " "), "tail": F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ")})
    heads, tails = (found.select("lang", F.col("phrase").alias(x), F.col("n").alias(y)) for x, y in (("head", "l"), ("tail", "r")))
    cut = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(sizes, "lang")
    big = {c: f"cast({c} AS decimal(20,0))" for c in "anlr"}
    score = F.expr(f"({big['a']} * {big['n']} * 1000BD) div ({big['l']} * {big['r']})")
    cut = cut.withColumn("score", score)
    best = cut.groupBy("lang", "phrase", "k", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    out = materialise(best.select("lang", "phrase", "k", "a", "b.l", "b.r", "n", "b.score"), "phrases")
    work.clear()
    return out


def top_phrases(found: DataFrame, top: int = TOP, parts: int = PARTS) -> DataFrame:
    """Each language's first ``top`` of :func:`collocations`, with their ``rank``: of each part of a language first, then of those."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def op11_phrases(spark, sf_dir) -> DataFrame:
    """Each language's first 2000 collocations, as :func:`collocations` has them."""
    found = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    return top_phrases(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT lang, w, i, unnest([1, 2, 3, 4, 5]) AS k FROM i),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a FROM k WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE k > 1),
x AS (
  SELECT c.lang, c.phrase FROM c JOIN c y ON y.lang = c.lang AND y.k > c.k AND y.a >= c.a AND contains(' ' || y.phrase || ' ', ' ' || c.phrase || ' ')),
d AS (SELECT *, string_split(phrase, ' ') AS w FROM c ANTI JOIN x USING (lang, phrase)),
e AS (SELECT *, unnest(range(1, k)) AS cut FROM d),
s AS (
  SELECT e.lang, e.phrase, e.a, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * e.a * t.n // (l.a::HUGEINT * r.a))::BIGINT AS score, cut
  FROM e JOIN f l ON l.lang = e.lang AND l.phrase = array_to_string(w[1:cut], ' ')
  JOIN f r ON r.lang = e.lang AND r.phrase = array_to_string(w[cut + 1:e.k], ' ') JOIN t ON t.lang = e.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""
