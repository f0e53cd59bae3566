"""Streamed windows with overlap, and kernels with a margin, on state of its own API.

A recording comes as array rows (key, first_sample, samples) cut anywhere.  Per
key the state holds what the next window still needs: a value with the next
sample to give out and a list with the samples from the window's beginning on.
The result is that of the batch form at any cut of the batches and after a
restart; rows that come early wait, rows that come again count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_HELD = "first_sample bigint, samples array<double>"


class Overlapping(StatefulProcessor):
    """Gives ``step`` samples at a time, made by the kernel of these and up to ``before`` and ``after`` samples around them.

    With ``whole`` all that the kernel makes of a window is given instead.  A
    row without samples (null) ends a recording: what is left is given with
    the samples there are.  With ``patience`` (milliseconds of processing
    time) a recording that gets no more rows ends as well.
    """

    def __init__(self, key: str, kernel: Callable[[np.ndarray], np.ndarray], step: int, before: int, after: int, whole: bool = False, patience: int | None = None):
        self.key, self.kernel, self.step, self.before, self.after, self.whole, self.patience = key, kernel, step, before, after, whole, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "at bigint")
        self.held = handle.getListState("held", _HELD)

    def _made(self, key, data: np.ndarray, begin: int, at: int, n: int, stop: int) -> dict:
        """The row for samples [at, at + n) of data that begin at ``begin``, from those before ``stop``."""
        low = max(begin, at - self.before)
        y = np.asarray(self.kernel(data[low - begin : stop - begin]), float)
        return {self.key: key[0], "first_sample": at, "samples": y if self.whole else y[at - low : at - low + n]}

    def _run(self, key, rows: list[tuple[int, np.ndarray]], ended: bool) -> list[dict]:
        at = self.next.get()[0] if self.next.exists() else None
        if self.held.exists():
            rows = [(int(r[0]), np.asarray(r[1], float)) for r in self.held.get()] + rows
        rows.sort(key=lambda r: r[0])
        if at is None and rows:
            at = 0
        begin = max(0, (at or 0) - self.before)
        parts, end, early = [], begin, []
        for first, x in rows:
            if first > end:
                early.append((first, x))
            elif first + len(x) > end:
                parts.append(x[end - first :])
                end = first + len(x)
        data = np.concatenate(parts) if parts else np.zeros(0)
        out = []
        while at is not None and end >= at + self.step + self.after:
            out.append(self._made(key, data, begin, at, self.step, at + self.step + self.after))
            at += self.step
        if ended:
            while at is not None and at < end and not (self.whole and at and at + self.after >= end):
                n = min(self.step, end - at)
                out.append(self._made(key, data, begin, at, n, min(end, at + n + self.after)))
                at += n
            self.next.clear()
            self.held.clear()
        elif at is not None:
            keep = max(0, at - self.before)
            left = [(keep, data[keep - begin :])] if end > keep else []
            self.held.put([(f, x.tolist()) for f, x in left + early])
            self.next.update((at,))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got, ended = [], False
        for batch in rows:
            for first, x in zip(batch["first_sample"], batch["samples"], strict=True):
                if x is None:
                    ended = True
                elif len(x):
                    got.append((int(first), np.asarray(x, float)))
        out = self._run(key, got, ended)
        if self.patience is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._table(self._run(key, [], True))

    def _table(self, out: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[self.key, "first_sample", "samples"])

    def close(self) -> None:
        pass


def stream_overlapping(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], step: int, before: int = 0, after: int = 0, key: str = "channel", whole: bool = False, patience: int | None = None) -> DataFrame:
    """A stream of rows (key, first_sample, samples) as :class:`Overlapping` gives it: key, first_sample, samples.

    A zero-phase filter is its kernel with the margin before and after; windows
    of ``size`` that overlap are ``step`` = size - overlap and ``after`` = overlap
    with ``whole``.  A recording begins at sample 0.  The query has to start
    with its state in RocksDB (:func:`~.stateful.rocksdb`).
    """
    kind = rows.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, first_sample bigint, samples array<double>"
    made = Overlapping(key, kernel, step, before, after, whole, patience)
    return rows.select(key, "first_sample", "samples").groupBy(key).transformWithStateInPandas(made, shape, "Append", "ProcessingTime" if patience is not None else "None")
