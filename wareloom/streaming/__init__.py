"""Structured Streaming ingest and merge."""
