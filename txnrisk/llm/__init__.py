"""Operators for preparing training text: filters, deduplication, tokens, packing."""
