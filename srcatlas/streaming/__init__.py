"""Structured Streaming: incremental indexing and event logs."""
