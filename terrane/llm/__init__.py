"""Training-data operators: sharding, quality, near and exact duplicates, secrets, personal data, packing, search.

Nothing else in the library imports this subpackage.
"""
