"""A PySpark-native engine for curating video training datasets."""
