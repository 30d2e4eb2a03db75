"""Training-data operators: scoring, filtering, extraction, deduplication, packing and sharding of documents."""
