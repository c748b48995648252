"""Incremental loading, in batch and as streams."""
