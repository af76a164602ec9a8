"""A PySpark-native engine for document-stream analytics."""
