"""Structured Streaming upkeep of the index."""
