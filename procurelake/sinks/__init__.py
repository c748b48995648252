"""Writers of every layer."""
