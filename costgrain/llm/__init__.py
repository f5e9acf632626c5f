"""Operators for training-data corpora: packing, search, sharding, mixing, scoring, dedup."""
