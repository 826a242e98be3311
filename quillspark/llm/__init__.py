"""Training-data operators: near-duplicates, deduplication, classifiers, mixing, token output.

Nothing outside this subpackage imports it.
"""
