"""Structured Streaming forms of limits, ingest and event counts."""
