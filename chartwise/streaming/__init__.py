"""Structured Streaming forms of incremental ingest and scoring."""
