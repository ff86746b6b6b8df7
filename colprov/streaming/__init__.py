"""Structured Streaming versions of the incremental jobs."""
