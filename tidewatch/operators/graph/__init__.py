"""Lineage graph: construction, statistics, tables, traversal and governance."""
