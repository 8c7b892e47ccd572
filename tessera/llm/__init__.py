"""Operators for preparing training text: deduplication, extraction, filtering, mixing, tokens, scores."""
