"""Structured Streaming forms of the incremental operators and their batch twins."""
