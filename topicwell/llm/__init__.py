"""Operators for preparing training text: deduplication, filters, mixing, packing and formatting."""
