"""Readers of label files, dataset trees, exports and manifests."""
