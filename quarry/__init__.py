"""quarry: a PySpark-native engine for querying and preparing document collections."""
