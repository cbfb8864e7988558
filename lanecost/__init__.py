"""Spark jobs that find, explain and audit unusual unit costs in event tables."""

__version__ = "0.1.0"
