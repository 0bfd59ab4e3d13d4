"""Operators for preparing training data: search, counting, filtering, deduplication, mixing and packing."""
