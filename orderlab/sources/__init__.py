"""orderlab.sources."""
