"""Operators of a training-data pipeline: search, scans, deduplication, scoring, encoding, packing."""
