"""Operators for building training data: extraction, scoring, deduplication, mixing, archives.

Nothing outside this package imports it. Each module holds one operator with its own general interface;
``queries.py`` derives the registered ``opN_`` queries from them.
"""
