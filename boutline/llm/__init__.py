"""Training-data operators: near-duplicates, packing, tokens, media, archives, filters.

Nothing outside this package imports it. Each module holds one operator; ``queries`` registers
the thin ``opN_*`` queries the entry point exposes.
"""
