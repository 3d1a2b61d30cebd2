"""Whole runs and the queries over the given tables."""
