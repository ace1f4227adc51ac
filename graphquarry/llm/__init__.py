"""Training-data operators: dedup, packing, sharding, tokenising, scoring, archives."""
