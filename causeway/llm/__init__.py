"""Operators for preparing training data: packing, sharding, decontamination, URL filters,
near-duplicate joins, secret scans, HTML extraction, substring de-duplication, language
identification and exact vector search.

Nothing else in the library imports this subpackage.  ``queries`` holds the registered queries.
"""
