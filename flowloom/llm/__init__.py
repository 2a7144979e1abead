"""Operators for large text corpora: mixing, deduplication, scoring, packaging."""
