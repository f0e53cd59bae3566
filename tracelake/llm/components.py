"""Connected components by alternating large and small stars, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _ends(edges: DataFrame, **values: tuple[str, str]) -> DataFrame:
    """Two rows an edge, one of each end: u, and each of ``values`` for hi and for lo."""
    ends = [F.struct(F.col(u).alias("u"), *(F.expr(v[i]).alias(k) for k, v in values.items())) for i, u in enumerate(("hi", "lo"))]
    return edges.select(F.inline(F.array(*ends)))


def _large(edges: DataFrame) -> DataFrame:
    both = _ends(edges, v=("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node is a root alone or has one edge alone, to a root: what a further round would leave as it is."""
    sides = _ends(edges, above=("0L", "1L"), below=("1L", "0L")).groupBy("u").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    return not sides.where("below > 1 OR below > 0 AND above > 0").agg(F.count(F.lit(1))).first()[0]


def components(links: DataFrame, work: Scratch, rounds: int = 100) -> DataFrame:
    """node, root (the component's least node) for every node that a link (columns a, b) touches.

    Each node is compared with the least of its neighbours, never with all of
    them at once; a node with very many neighbours is split by Spark's skew
    handling in the joins and combined before the shuffles of the minima.
    ``work`` gets the result; the rounds' own tables are removed.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    held = Scratch(links.sparkSession)
    edges = held.write(edges, "links")
    for _ in range(rounds):
        if _settled(edges):
            break
        later = Scratch(links.sparkSession)
        edges = later.write(_small(_large(edges)), "stars")
        held.clear()
        held = later
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())
    out = work.write(out, "roots")
    held.clear()
    return out
