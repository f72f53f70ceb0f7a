"""Operators of a training-data pipeline: language, quality, near duplicates, tokens, packing, archives.

Nothing else in the library imports this package. ``catalog`` holds the registered queries.
"""
