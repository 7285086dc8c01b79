"""Training-data operators: fingerprints, scans, formatting, sharding, tokens, deduplication, media, packing, language.

Nothing else in the library imports this subpackage.
"""
