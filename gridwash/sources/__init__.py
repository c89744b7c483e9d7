"""Readers, writers, ingest and landing-zone checks."""
