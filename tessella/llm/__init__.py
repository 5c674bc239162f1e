"""Operators for building text corpora: extraction, filtering, deduplication, scoring, packing."""
