"""Operators for preparing training text: filtering, deduplication, redaction, mixing, tokens and chat formats."""
