"""Training-data operators: deduplication, filters, scoring and mixing.

Nothing else in the library imports this subpackage, and it imports nothing of the rest but the storage of intermediate tables.
"""
