"""Operators of a training-data pipeline: scoring, encoding, search, classification, packing, sharding, deduplication."""
