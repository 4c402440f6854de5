"""Training-data operators: sharding, dedup, filters, classifiers, packing, archives.

Nothing outside this package imports it; it can be removed as a whole.
"""
