"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; :mod:`tidemark.llm.queries` holds the thin registered
queries that run them over whole tables.
"""
