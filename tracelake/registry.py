"""Queries of the engine and their SQL."""

from __future__ import annotations

from .plans import convert, files, jobs, signals, spikes

QUERIES: dict = signals.QUERIES | spikes.QUERIES | jobs.QUERIES | files.QUERIES | convert.QUERIES
ORACLE_SQL: dict = signals.SQL | spikes.SQL | jobs.SQL | files.SQL | convert.SQL
FLAGSHIP = spikes.QUERIES["spike_features"]
