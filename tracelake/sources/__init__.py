"""Readers and writers of recordings, metadata and wiring."""
