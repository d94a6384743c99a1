"""Operators of a training-data pipeline: quality, duplicates, secrets, mixing, tokens, archives, search."""
