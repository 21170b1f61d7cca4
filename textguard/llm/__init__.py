"""Operators of a training-data pipeline: formatting, filters, near-duplicates, search, mixing, packing."""
