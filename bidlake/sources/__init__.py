"""Readers and writers that turn files and raw pages into tables."""
