"""Operators for preparing training text: filters, deduplication, scoring, encoding, packing."""
