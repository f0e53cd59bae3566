"""Samples of each group by the least hashes: a mergeable aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task holds before it leaves out those beyond each group's least, and those that it then gives on.
HELD, GIVEN = 50_000, 200_000
#: Parts of a group whose rows are brought together first.
PARTS = 64


def _least(table: pa.Table, key: int, order: int, k: int) -> pa.Table:
    """Rows of each key (a column's place) with the k least of the order column; all that equal the last of them."""
    if not table.num_rows:
        return table
    codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
    by = np.lexsort((value := table.column(order).to_numpy(), codes))
    codes, value = codes[by], value[by]
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    first = np.repeat(start, np.diff(np.r_[start, len(codes)]))
    last = np.minimum(first + k - 1, len(codes) - 1)
    # where a group has fewer than k rows, its last one counts
    end = np.repeat(np.r_[start[1:], len(codes)], np.diff(np.r_[start, len(codes)])) - 1
    return table.take(pa.array(by[value <= value[np.minimum(last, end)]]))


def least_of_each(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """Rows of each key with the ``k`` least of ``order`` (whole numbers, no nulls), and those that equal the last of them.

    The sets of least rows of parts of a group merge into the group's: each
    task keeps those of what it reads, parts of groups come together next, and
    groups last, so that no task gets more than ``PARTS`` times ``k`` rows of
    a group.  Nothing is sorted by group; all columns stay as they are.
    """
    at, by = df.columns.index(key), df.columns.index(order)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, limit = 0, HELD
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= limit:
                left = _least(pa.Table.from_batches(held), at, by, k)
                if left.num_rows > GIVEN:  # many groups: what they merge into is the same
                    yield from left.to_batches()
                    left = left.slice(0, 0)
                held, count = left.combine_chunks().to_batches(), left.num_rows
                limit = max(HELD, 2 * count)
        if count:
            yield from _least(pa.Table.from_batches(held), at, by, k).to_batches()

    out = df.mapInArrow(prune, df.schema)
    out = out.repartition(key, F.pmod(F.spark_partition_id(), F.lit(PARTS))).mapInArrow(prune, df.schema)
    return out.withColumn("__rank", F.rank().over(Window.partitionBy(key).orderBy(order))).where(F.col("__rank") <= k).drop("__rank")


def random_of_each(df: DataFrame, key: str, id_col: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows of each key at most, those of the least MD5 of id and seed, ties to the lesser id; all columns as they are."""
    digest = F.md5(F.concat_ws(":", F.col(f"`{id_col}`").cast("string"), F.lit(str(seed))))
    rows = df.withColumn("__digest", digest).withColumn("__order", F.conv(F.substring("__digest", 1, 15), 16, 10).cast("long"))
    rows = least_of_each(rows, key, "__order", k)
    chosen = Window.partitionBy(key).orderBy("__digest", id_col)
    return rows.withColumn("__pick", F.row_number().over(chosen)).where(F.col("__pick") <= k).drop("__pick", "__digest", "__order")
