"""Operators that prepare training text: deduplication, scoring, mixing, packing and token files."""
