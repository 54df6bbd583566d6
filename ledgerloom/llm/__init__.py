"""Operators for large text corpora: filtering, deduplication, packing and encoding."""
