"""Operators for preparing training data for language models.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; the thin contract queries are in
:mod:`tempolog.llm.queries`.
"""
