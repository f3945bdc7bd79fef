"""Operators for building training data: filters, duplicates, tokenizing, packing, formatting.

Nothing else in the library imports this subpackage.
"""
