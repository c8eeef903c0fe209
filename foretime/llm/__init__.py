"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this subpackage imports it; ``queries`` registers what it offers.
"""
