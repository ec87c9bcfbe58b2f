"""Sources of the place-data engine."""
