"""Functions of the place-data engine."""
