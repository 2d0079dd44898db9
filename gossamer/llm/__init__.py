"""Training-data operators: deduplication, filtering, scoring, tokenization and media columns.

Nothing outside this folder imports it; the rest of the library works without it.
"""
