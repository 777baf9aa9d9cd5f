"""Training-data operators: archives, deduplication, classifiers, tokens, packing.

Nothing else in the library imports this subpackage.
"""
