"""Scalar functions on keys, events and definition texts."""
