"""Operators of a training-data pipeline: filters, deduplication, tokenising, packing, archives and media.

Nothing outside this subpackage imports it.
"""
