"""Mixing sources to target weights by hash thresholds.

Each source's documents are ordered by a hash of their id.  A first histogram
sums sizes by source and the hash's leading bits; in each source the budget
falls into one bucket.  Only the documents of that boundary bucket are summed
again, by the next bits, until a bucket holds one hash value.  What lies below
the threshold is taken: a filter, no sort.  A source that is to be repeated
takes whole copies first and hash-chosen documents once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, materialise, words_of

#: The hash has 60 bits, five levels of 12.
LEVEL_BITS, LEVELS = 12, 5
MAX_REPEATS = 3


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def hash_of(key: Column) -> Column:
    """60 bits of the MD5 of the key as text; a null key is the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _ranked(sizes: DataFrame, work: Scratch) -> DataFrame:
    """``sizes`` with each source's ``rank`` by code point, null last: sorted by ranges, the ranges' counts added up."""
    order = (F.col("source").isNull(), F.col("source"))
    dealt = work.write(sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before, starts = 0, {}
    for row in sorted(dealt.groupBy("range").count().collect()):  # one for each partition
        starts[row["range"]], before = before, before + row["count"]
    start = F.element_at(F.create_map(*(F.lit(x) for k, v in starts.items() for x in (k, v))), F.col("range")) if starts else F.lit(0)
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.withColumn("rank", start + within).drop("range")


def targets(sizes: DataFrame, work: Scratch, weights=(1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources (columns source, source_size) that share the sum of all sizes.

    Sources by code point, null last, weigh ``weights`` in turn.  A target
    stops at ``repeats`` times its source's size, and the excess is reshared
    by weight until none is above: in each round one aggregation over the
    sources sums what those that are above take, and the others' weights.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = work.write(_ranked(sizes, work).withColumn("w", w).withColumn("cap", F.col("source_size") * float(repeats)), "mix-weights")
    total, left_w = ranked.agg(F.sum("source_size").cast("double"), F.sum("w")).first()
    left = total
    while total:
        above = F.col("cap") * left_w < F.lit(left) * F.col("w")
        taken, rest = ranked.agg(F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        if (total - taken, rest) == (left, left_w):
            break
        left, left_w = total - taken, rest
    above = F.col("cap") * F.lit(left_w) < F.lit(left) * F.col("w")
    return ranked.select("source", "source_size", F.when(above, F.col("cap")).otherwise(F.lit(left) * F.col("w") / F.lit(left_w)).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("hash", LEVEL_BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1).cast("long"))


def thresholds(docs: DataFrame, budgets: DataFrame, work: Scratch) -> DataFrame:
    """For each source (skey) the largest hash that is taken, -1 if none.

    ``docs``: skey, hash, size; ``budgets``: skey, budget.  A document at the
    boundary is taken if that brings the sum nearer to the budget.
    """
    left = budgets.select("skey", F.col("budget").cast("double").alias("budget"), F.lit(0).cast("long").alias("prefix"))
    rest, done = docs, None
    for level in range(LEVELS):
        sums = rest.groupBy("skey", _bucket(level).alias("bucket")).agg(F.sum("size").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        w = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        cut = sums.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0))).join(left, "skey")
        # the last bucket that begins within the budget
        cut = cut.where(F.col("before") <= F.col("budget")).groupBy("skey").agg(F.max_by(F.struct("bucket", "size", "lo", "hi", "before", "budget"), "bucket").alias("b")).select("skey", "b.*")
        cut = work.write(cut, f"mix-level{level}")
        one = F.col("lo") == F.col("hi")
        taken = F.when(F.col("before") + F.col("size") / 2 <= F.col("budget"), F.col("hi")).otherwise(F.col("lo") - 1)
        whole = F.col("before") + F.col("size") <= F.col("budget")
        ended = one | whole
        found = cut.where(ended).select("skey", F.when(whole, F.col("hi")).otherwise(taken).alias("last"))
        done = found if done is None else done.unionByName(found)
        open_ = cut.where(~ended)
        if level == LEVELS - 1 or open_.isEmpty():
            break
        edge = open_.select("skey", F.col("bucket").alias("at"))
        rest = work.write(rest.join(edge, "skey").where(_bucket(level) == F.col("at")).select("skey", "hash", "size"), f"mix-edge{level}")
        left = open_.select("skey", (F.col("budget") - F.col("before")).alias("budget"))
    return done


def _key(source: Column) -> Column:
    """Null is a key of its own that no text can have."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def mix_plan(rows: DataFrame, weights=(1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each source of ``rows`` (skey, source, hash, size): its sizes, whole copies and threshold."""
    work = Scratch(rows.sparkSession)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = work.write(targets(sizes, work, weights, repeats).withColumn("skey", _key(F.col("source"))), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("full", full)
    budgets = goal.where("source_size > 0").select("skey", F.when(F.col("full") < repeats, F.col("target") - F.col("full") * F.col("source_size")).otherwise(0.0).alias("budget"))
    last = thresholds(rows.select("skey", "hash", "size"), budgets, work)
    out = materialise(goal.drop("source").join(last, "skey", "left"), "mix-plan")
    work.clear()
    return out


def _planned(rows: DataFrame, plan: DataFrame, repeats: int) -> DataFrame:
    more = F.when((F.col("full") < repeats) & (F.col("hash") <= F.col("last")), 1).otherwise(0)
    return rows.join(plan, "skey").withColumn("copies", (F.col("full") + more).cast("long"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size_of(F.col(f"`{text_col}`")).alias("size"))
    return materialise(rows.select("id", "source", _key(F.col("source")).alias("skey"), hash_of(F.col("id")).alias("hash"), "size"), "mix-docs")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """Per row: id, source, size, source_size, target and ``copies``, how often the mix takes it (0 to ``repeats``).

    A null text has size 0, a null source is a source of its own, rows with
    one id are taken together, other columns are left out (none can clash),
    an empty table gives none.  Whatever its sizes, nothing is random: reruns
    agree.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    out = _planned(rows, mix_plan(rows, weights, repeats), repeats)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` as the mix has them: a row as often as it is taken, all columns as they are."""
    plan = mix_plan(_sized(docs, id_col, text_col, source_col), weights, repeats).select(F.col("skey").alias("__skey"), F.col("full").alias("__full"), F.col("last").alias("__last"))
    keyed = docs.withColumn("__skey", _key(F.col(f"`{source_col}`"))).withColumn("__hash", hash_of(F.col(f"`{id_col}`")))
    more = F.when((F.col("__full") < repeats) & (F.col("__hash") <= F.col("__last")), 1).otherwise(0)
    copies = (F.col("__full") + more).cast("int")
    taken = keyed.join(plan, "__skey").withColumn("__copy", F.explode(F.array_repeat(F.lit(True), copies)))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_mix_sources(spark, sf_dir) -> DataFrame:
    """One row per document with the words that the mix takes of it."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER o - cap) AS rest, sum(w) OVER () - (sum(w) OVER o - w) AS rest_w
  FROM s WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, cap * rest_w < rest * w AS capped FROM f),
h AS (SELECT rest AS r, rest_w AS rw FROM c WHERE NOT capped ORDER BY cap / w LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE r * w / rw END AS target
  FROM c LEFT JOIN h ON true),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS full_copies FROM t),
u AS (
  SELECT source, hash, sum(size) AS usize, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d GROUP BY source, hash)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.full_copies + CASE WHEN p.full_copies < 3 AND p.source_size > 0
          AND u.before + u.usize / 2.0 <= p.target - p.full_copies * p.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.hash = u.hash
"""
