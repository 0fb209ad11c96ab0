"""Structured Streaming maintenance of rollups."""
