"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; removing it removes the
operators, their queries and `corpus_pipeline.py`, and nothing more.
"""
