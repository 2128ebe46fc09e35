"""Relational operators over images, boxes and predictions."""
