"""Transforms of string collections, and what can be asked of them."""
