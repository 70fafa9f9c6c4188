"""operators of the analytics engine."""
