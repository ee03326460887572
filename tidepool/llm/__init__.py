"""Operators for preparing training text: counts, filters, duplicates, mixing, encoding."""
