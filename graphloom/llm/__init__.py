"""Training-data operators: scans, deduplication, scoring and mixing of document tables.

Nothing outside this subpackage imports it.
"""
