"""Training-data operators: filtering, deduplication, tokens, packing, archives.

Nothing outside this package imports it; ``queries`` registers its queries.
"""
