"""Incremental ingest and the session lifecycle as Structured Streaming jobs."""
