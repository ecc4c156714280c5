"""A PySpark-native document-analytics and retrieval engine."""
