"""Operators for training-data corpora: one module each, queries in ``queries``."""
