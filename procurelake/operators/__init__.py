"""DataFrame operators: cleaning, mapping, deduplication, aggregation, quality, profile."""
