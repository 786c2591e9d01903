"""Training-data operators: packing, token counts, secrets, mixing, near-duplicates, search, filters, quality.

Each module holds one operator with a general interface; ``queries`` derives the registered digests from them.
Nothing outside this subpackage imports it.
"""
