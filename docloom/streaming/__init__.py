"""Structured Streaming forms of the stateful mechanisms."""
