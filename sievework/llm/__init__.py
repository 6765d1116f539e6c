"""Training-data operators: tokenising, deduplication, filtering, formatting and packing.

Nothing else in the library imports this subpackage.
"""
