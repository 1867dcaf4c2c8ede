"""Readers and writers: point files, message logs, photos, camera models."""
