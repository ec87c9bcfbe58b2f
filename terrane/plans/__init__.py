"""Plans of the place-data engine."""
