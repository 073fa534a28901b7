"""Operators of a training-data pipeline: deduplication, search, tokens, filters, mixing."""
