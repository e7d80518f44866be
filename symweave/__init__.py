"""Spark-native analytics for versioned code-knowledge graphs."""
