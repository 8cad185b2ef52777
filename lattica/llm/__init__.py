"""Training-data operators: packing, deduplication, classification, archives, search.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
