"""Terrane: a Spark-native engine for place data (bronze, silver, gold) and its queries."""
