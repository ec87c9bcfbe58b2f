"""Operators of the place-data engine."""
