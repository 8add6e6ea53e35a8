"""Operators for training-data pipelines: filtering, dedup, encoding, packing, formatting."""
