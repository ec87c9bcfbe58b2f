"""Streaming of the place-data engine."""
