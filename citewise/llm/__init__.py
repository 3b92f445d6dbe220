"""Operators for preparing training data: duplicates, languages, licences, mixing, sharding, tokens and vector search."""
