"""orderlab.operators."""
