"""Operators for building training corpora: filters, deduplication, scoring, tokens, shards and vector search.

Nothing outside this folder imports it. Each module holds one operator with a general interface; ``queries``
registers the thin contract queries on top of them.
"""
