"""Training-data operators: quality, mixing, tokenisation, media, safety and near-duplicate search.

Nothing outside this subpackage imports it.
"""
