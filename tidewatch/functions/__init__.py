"""Column-to-Column functions. Everything here stays inside whole-stage code generation."""
