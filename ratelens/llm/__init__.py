"""Training-data operators: scoring, filters, deduplication, packing, tokens.

Nothing outside this package imports it; ``queries`` registers one query per
operator and the corpus pipeline.
"""
