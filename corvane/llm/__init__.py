"""Operators of a training-data pipeline: filters, de-duplication, mixing, encoding and search."""
