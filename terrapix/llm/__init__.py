"""Training-data operators: each takes a DataFrame of documents (or pages) and returns one.

Nothing outside this subpackage imports it.
"""
