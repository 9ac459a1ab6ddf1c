"""Incremental loads and streaming forms of them."""
