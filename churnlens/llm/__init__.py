"""Operators for training-data pipelines (documents, pages, conversations).

Nothing else in the library imports this subpackage.
"""
