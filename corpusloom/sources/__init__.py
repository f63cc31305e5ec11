"""sources of the sequence-record engine."""
