"""Operators for large text corpora: search, deduplication, filters, formats.

Nothing else in the package imports this subpackage.
"""
