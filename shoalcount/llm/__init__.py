"""Operators for preparing training text: quality, language, dedup, privacy, mixing, tokens, vectors."""
