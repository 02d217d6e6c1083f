"""Composite jobs and the bindings to the synthetic tables."""
