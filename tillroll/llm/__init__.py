"""Operators on text corpora: counting, cleaning, deduplication, scoring and packing."""
