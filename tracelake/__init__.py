"""A PySpark-native analytics engine for allocation traces."""
