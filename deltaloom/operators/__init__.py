"""Relational and byte-level operators over blobs and chunks."""
