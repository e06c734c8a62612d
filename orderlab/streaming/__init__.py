"""orderlab.streaming."""
