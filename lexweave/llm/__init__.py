"""Training-data operators: dedup, quality, mixing, packing, search and language-model scoring.

Nothing else in the library imports this subpackage.
"""
