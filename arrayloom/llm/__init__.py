"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; every operator works on
whole tables and whole texts, and keeps its own general interface.  The thin
registered queries are in :mod:`arrayloom.llm.queries`.
"""
