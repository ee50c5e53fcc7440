"""Structured Streaming versions of the incremental plans."""
