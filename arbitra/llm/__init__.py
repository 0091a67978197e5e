"""Operators of a training-data pipeline: cleaning, deduplication, formatting, mixing, counting."""
