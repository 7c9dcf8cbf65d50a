"""Operators of a training-data pipeline over text corpora.

Nothing outside this package imports it; it can be deleted without effect on the rest of the library.
"""
