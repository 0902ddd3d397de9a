"""Fixed configuration tables."""
