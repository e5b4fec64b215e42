"""Training-data operators: search, deduplication, filtering, tokenising and sharding of text corpora."""
