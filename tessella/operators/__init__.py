"""Relational operators: position, grouping, joins, sets, statistics, frames, matrices."""
