"""Training-data operators: deduplication, scoring, mixing, sharding and scans over document tables."""
