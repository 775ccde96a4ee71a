"""Training-data operators: mixing, filtering, classification, deduplication.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
