"""Operators for training-data pipelines: search, tokenising, de-duplication,
cleaning, scoring and packing over the ``documents`` and ``embeddings`` tables.

Nothing outside this folder imports it.
"""
