"""Relational operators: selection, joins, aggregates, row order, gaps, models."""
