"""Operators for training-data pipelines: scoring, mixing, search, deduplication, screening and extraction."""
