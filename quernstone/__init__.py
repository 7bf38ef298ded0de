"""A PySpark-native SQL and DataFrame analytics engine."""
