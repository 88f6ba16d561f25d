"""Operators for training-data pipelines: quality, extraction, deduplication, privacy, mixing, output."""
