"""Operators of a training-data pipeline: sharding, tokens, search, quality, duplicates, mixing, languages, archives."""
