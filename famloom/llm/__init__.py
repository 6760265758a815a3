"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it may be removed as a
whole.  ``famloom.llm.queries`` holds the registered queries and their SQL.
"""
