"""Operators for training-data pipelines over documents, embeddings and web pages.

Each module holds one operator with a general interface; `queries` registers them.
Nothing outside this package imports it.
"""
