"""Operators for preparing training data: deduplication, quality, packing, tokens, search.

Nothing outside this subpackage imports it. Each module holds one operator, ``queries``
holds the registered queries.
"""
