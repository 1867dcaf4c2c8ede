"""Structured Streaming versions of the map build."""
