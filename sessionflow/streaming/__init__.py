"""Structured Streaming forms of the tick aggregates."""
