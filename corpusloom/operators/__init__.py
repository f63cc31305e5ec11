"""operators of the sequence-record engine."""
