"""Joins, reports, dimensions, quality checks, compliance and graph operators."""
