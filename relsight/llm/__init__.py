"""Training-data operators: deduplication, joins, packing, tokens, filters."""
