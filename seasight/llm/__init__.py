"""Training-data operators: deduplication, language ID, tokenising, mixing and the like.

Nothing outside this subpackage imports it.
"""
