"""Structured Streaming forms of the windowed metrics."""
