"""Training-data operators: near duplicates, language, quality, packing, mixing and the like.

Nothing outside this subpackage imports it.
"""
