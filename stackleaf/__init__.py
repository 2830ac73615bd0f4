"""A PySpark-native engine for personal document and bookmark libraries."""
