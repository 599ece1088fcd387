"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it may be deleted as a
whole.  ``queries.py`` holds the thin ``opN_<name>`` queries.
"""
