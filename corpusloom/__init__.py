"""A PySpark-native engine for large collections of sequence records."""
