"""A PySpark-native engine for exhaustive read-to-target sequence matching."""
