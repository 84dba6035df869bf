"""Operators of a training-data pipeline: mixing, cleaning, de-duplication, archives, extraction."""
