"""Structured Streaming: incremental ingest and the request limiter."""
