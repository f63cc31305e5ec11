"""plans of the sequence-record engine."""
