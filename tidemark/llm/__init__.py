"""Operators for training-data pipelines: deduplication, extraction, scoring, archives and mixing.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
