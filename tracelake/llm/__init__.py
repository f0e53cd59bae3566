"""Training-data operators: quality, secrets, dedup, mixing, scoring, extraction, tokens, phrases, resampling.

Nothing outside this subpackage imports it.  ``registry.QUERIES`` and
``registry.ORACLE_SQL`` hold its queries.
"""
