"""Operators for training-data pipelines: scoring, deduplication, search, formatting and packing of documents."""
