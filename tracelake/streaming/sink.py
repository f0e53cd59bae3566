"""A flat recording file that a stream appends to, every sample once."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.files import cut_back, write_flat
from ..sources.recording import between, local_path

_LAST = (1 << 62) - 1


def committed(path: str, channels: int, itemsize: int = 2) -> int:
    """Samples that a file holds, less what an append that died has left (which is cut off)."""
    at = local_path(path)
    if not os.path.exists(at):
        return 0
    cut_back(at)
    return os.path.getsize(at) // (channels * itemsize)


def append_flat(stream: DataFrame, path: str, channels: int, at: str, scale: float = 1.0) -> DataStreamWriter:
    """Writer of a stream (first_sample, channel, samples) into an int16 file, with its checkpoint under ``at``.

    Each epoch goes on where the file ends: samples that it has already, as in
    an epoch that is run again after a crash, are left out, and an epoch that
    would leave a gap is refused.  An epoch's samples count once its append is
    committed, whole or not at all.  Blocks come with all channels in an epoch.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        done = committed(path, channels)
        batch = batch.persist()
        try:
            rows = between(batch, done, _LAST)
            first = rows.agg(F.min("first_sample")).first()[0]
            if first is None:
                return
            if first != done:
                raise ValueError(f"epoch {epoch} begins at sample {first}, the file ends at {done}")
            write_flat(rows, path, channels, scale, append=True)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint")
