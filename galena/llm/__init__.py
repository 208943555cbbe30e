"""Operators for preparing training text: scoring, deduplication, sharding, tokens, search, mixing.

Nothing else in the library imports this subpackage; it stands alone and can be removed.
"""
