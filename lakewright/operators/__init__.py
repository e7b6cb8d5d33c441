"""Relational operators on DataFrames: validation, joins, aggregates, windows, matrices, graphs."""
