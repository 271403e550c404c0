"""Operators for large text corpora; queries.py registers them."""
