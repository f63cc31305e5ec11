"""functions of the sequence-record engine."""
