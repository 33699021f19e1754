"""Operators for preparing training corpora: fingerprints, archives, deduplication, quality, packing, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
