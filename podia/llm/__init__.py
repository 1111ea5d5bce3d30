"""Training-data operators: dedup, mixing, language ID, tokenisation, sharding."""
