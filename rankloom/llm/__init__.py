"""Operators that prepare training text: formatting, filters, deduplication, scoring, tokenising and packing."""
