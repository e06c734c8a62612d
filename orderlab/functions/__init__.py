"""orderlab.functions."""
