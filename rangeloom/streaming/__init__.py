"""Incremental processing of snapshots with Structured Streaming."""
