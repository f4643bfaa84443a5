"""Training-data operators: scoring, deduplication, packing, mixing, token counts and web archives."""
