"""Operators for training data: dedup, sharding, fingerprints, language, search, toxicity, mixing, archives, packing."""
