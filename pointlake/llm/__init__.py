"""Operators for preparing text corpora. Nothing else in this library imports them."""
