"""Operators for training-data corpora: dedup, archives, fingerprints, filters, sharding, scoring, mixing, packing."""
