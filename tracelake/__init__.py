"""Tracelake: a PySpark engine for many-channel recordings."""
