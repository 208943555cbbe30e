"""Causal measures on streams."""
