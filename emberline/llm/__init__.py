"""Training-data operators: deduplication, sharding, tokens, quality, language, packing and archives.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
