"""Readers, flatteners, sinks and adapters."""
