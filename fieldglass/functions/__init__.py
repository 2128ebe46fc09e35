"""Scalar expressions: geometry, keys, metrics."""
