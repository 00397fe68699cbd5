"""Training-data operators: scans, filters, extraction, deduplication and mixing over text tables.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
