"""A PySpark-native engine for code-knowledge graphs."""
