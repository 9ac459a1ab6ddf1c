"""Marts, measures and whole-run compositions over the star schema."""
