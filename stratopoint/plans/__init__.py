"""Derived inputs, the query registry and the end-to-end jobs."""
