"""Structured Streaming forms of the running metrics."""
