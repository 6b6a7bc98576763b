"""Training-data operators: scans, filters and deduplication over document tables.

Nothing outside this subpackage imports it.
"""
