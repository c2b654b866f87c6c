"""Relational operators: joins, aggregates, graphs, windows over the catalog."""
