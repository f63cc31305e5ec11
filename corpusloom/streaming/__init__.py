"""streaming of the sequence-record engine."""
