"""Relational operators: projection, joins, grouping, windows, sorting, sets, reshaping, UDFs."""
