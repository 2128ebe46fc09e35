"""Queries over the driver tables, their SQL twins, and plan helpers."""
